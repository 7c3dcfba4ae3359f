"""Name normalization: a comma-separated product name becomes 17 typed columns.

Tokens are read from left to right and each may depend on what the earlier ones did (the Basic
Type can change, columns fill up), so the core is one ``aggregate`` per row over the row's own
tokens. It needs no shuffle and no join: the rule tables are literals inside the expression, and
rows are independent, so the work splits over any number of tasks and no key can be hot.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import RuleError
from provender.functions.expressions import (
    compile_wide_rows,
    constant,
    either,
    let,
    lookup,
    packed,
    strip,
    unpacked,
)
from provender.rules.conditional import Rule, When
from provender.rules.fixed_values import COLLAPSE, COLLAPSE_ORDER
from provender.rules.ruleset import RuleSet

NON_FOOD = "Non-Food"

# Names of the state fields inside the fold, one per tag column.
_TAG_FIELDS = [f"c{i}" for i in range(len(S.TAG_COLUMNS))]
_CATEGORY_FIELDS = ["fpg", "fpc", "pfpc"]
_TAGS_DDL = "struct<" + ",".join(f"{c}:string" for c in _TAG_FIELDS) + ">"
_CATEGORIES_DDL = "struct<" + ",".join(f"{c}:string" for c in _CATEGORY_FIELDS) + ">"
# ``tags`` is a struct of its own, so that a token that changes no column hands it on whole.
_STATE_DDL = (
    f"struct<route:string,bt:string,st:array<string>,tags:{_TAGS_DDL},cats:{_CATEGORIES_DDL}>"
)
_NO_SUBTYPES = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NO_SUBTYPES)


def resolve_token(raw: Column, rules: RuleSet) -> Column:
    """Strip, lower-case and correct one token."""
    return let(
        let(F.trim(F.lower(raw)), strip), lambda t: F.coalesce(lookup(t, rules.corrections, "string"), t)
    )


def split_tokens(name: Column, rules: RuleSet) -> Column:
    """All tokens of a name, resolved. Empty tokens stay."""
    return F.transform(F.split(name, ",", -1), lambda t: resolve_token(t, rules))


def _state_literal(row: dict, route: str) -> dict:
    return {
        "route": route,
        "bt": row.get(S.BASIC_TYPE),
        "st": list(row.get(S.SUB_TYPES, [])),
        "tags": {f: row.get(c) for f, c in zip(_TAG_FIELDS, S.TAG_COLUMNS)},
        "cats": {f: row.get(c) for f, c in zip(_CATEGORY_FIELDS, S.CATEGORY_LABELS)},
    }


def initial_state(basic_type: Column, rules: RuleSet) -> Column:
    """State after the first token: its type, expanded by the type map."""
    table = {
        key: _state_literal({S.BASIC_TYPE: key, **row}, "fold")
        for key, row in rules.type_map.items()
    }
    empty = constant(_state_literal({}, "fold"), _STATE_DDL)
    plain = F.struct(
        empty["route"].alias("route"),
        basic_type.alias("bt"),
        *[empty[f].alias(f) for f in ("st", "tags", "cats")],
    )
    return F.coalesce(lookup(basic_type, table, _STATE_DDL), plain)


# --- rule tables ---------------------------------------------------------------------------------

_RULE_DDL = (
    "struct<"
    + ",".join(
        f"{f}:array<string>"
        for f in (
            "group",
            "category",
            "type",
            "first_subtype",
            "not_group",
            "not_category",
            "not_type",
        )
    )
    + ",drop:boolean,rename:string,self:boolean,retype:string,front:boolean,add:array<string>,"
    + f"tags:{_TAGS_DDL}>"
)
_WORD_DDL = (
    "struct<col:int,categories:array<string>,not_groups:array<string>,"
    "token_rules:array<int>,subtype_rules:array<int>>"
)
_CONDITIONS = ("group", "category", "type", "first_subtype")


def _rule_row(rule: Rule, when: When, rules: RuleSet, add: list[str] | None) -> dict:
    row = {f: list(getattr(when, f)) for f in _CONDITIONS if getattr(when, f)}
    for name in when.type_lists:
        row["type"] = [*row.get("type", []), *rules.vocabularies[name]]
    row |= {
        f"not_{f}": list(getattr(when, f"not_{f}"))
        for f in _CONDITIONS[:3]
        if getattr(when, f"not_{f}")
    }
    row |= {
        "drop": rule.drop or bool(rule.retype),
        "rename": rule.rename,
        "self": rule.retype is True,
        "retype": rule.retype if isinstance(rule.retype, str) else None,
        "front": rule.front,
        "add": add,
    }
    if rule.assign:
        row["tags"] = {
            f: rule.assign[c] for f, c in zip(_TAG_FIELDS, S.TAG_COLUMNS) if c in rule.assign
        }
    return row


def _compile(rules: RuleSet) -> tuple[list[dict], dict[str, dict]]:
    """The rule table and the word table.

    Each condition of each rule is a row of the rule table. A word names the rows that mention it,
    in order, so a token is tried against its own few rules only, and the plan has the same size
    for any number of rules.
    """
    table: list[dict] = []
    words: dict[str, dict] = {}

    def mention(word: str, kind: str, number: int) -> None:
        words.setdefault(word, {}).setdefault(kind, []).append(number)

    for kind, group in (("token_rules", rules.token_rules), ("subtype_rules", rules.subtype_rules)):
        for rule in group:
            for when in rule.when:
                tokens = dict.fromkeys(when.tokens)
                for name in when.lists:
                    tokens.update(dict.fromkeys(rules.vocabularies[name]))
                if rule.expand:
                    for word in tokens:
                        mention(word, kind, len(table))
                        table.append(_rule_row(rule, when, rules, list(rule.expand[word])))
                    continue
                for word in tokens:
                    mention(word, kind, len(table))
                table.append(_rule_row(rule, when, rules, list(rule.add) or None))

    number = {column: i for i, column in enumerate(S.TAG_COLUMNS)}
    for category, gate in rules.gates.items():
        for tag, column in gate.items():
            entry = words.setdefault(tag, {})
            if entry.setdefault("col", number[column]) != number[column]:
                raise RuleError(f"tag {tag!r} is in two columns")
            entry.setdefault("categories", []).append(category)
    for group_name, tags in rules.unplaced_tags.items():
        for tag in tags:
            words.setdefault(tag, {}).setdefault("not_groups", []).append(group_name)
    return table, words


class _Fold:
    """The expressions of one fold step, over the row's category and the compiled tables."""

    def __init__(self, group: Column, category: Column, gate: Column, rules: RuleSet):
        self.group, self.category, self.gate = group, category, gate
        table, self.words = _compile(rules)
        self.table = constant(table, f"array<{_RULE_DDL}>")

    def word(self, token: Column) -> Column:
        return lookup(token, self.words, _WORD_DDL)

    def rule(self, number: Column) -> Column:
        return F.get(self.table, number)

    def first_rule(self, numbers: Column, state: Column) -> Column:
        """The first of the numbered rules whose conditions the row meets, or null."""
        row = {
            "group": self.group,
            "category": self.category,
            "type": state["bt"],
            "first_subtype": F.get(state["st"], F.lit(0)),
        }

        def holds(rule: Column) -> Column:
            result = F.lit(True)
            for name in _CONDITIONS:
                result = result & (
                    rule[name].isNull() | F.array_contains(rule[name], row[name])
                )
            for name in _CONDITIONS[:3]:
                words = rule[f"not_{name}"]
                result = result & (
                    words.isNull() | ~F.coalesce(F.array_contains(words, row[name]), F.lit(False))
                )
            return result

        met = F.filter(numbers, lambda number: let(self.rule(number), holds))
        return self.rule(F.get(met, F.lit(0)))

    def column_of(self, word: Column) -> Column:
        """Number of the tag column that takes the word in this row's category, or null."""
        kept_out = F.coalesce(F.array_contains(word["not_groups"], self.group), F.lit(False))
        allowed = F.array_contains(word["categories"], self.gate) & ~kept_out
        return either(allowed, word["col"])

    def step(self, state: Column, token: Column) -> Column:
        """One token: token rules, then placement in a column, then sub-type rules."""

        def after_token_rule(word: Column) -> Column:
            def placement(rule: Column) -> Column:
                out = either(
                    ~F.coalesce(rule["drop"], F.lit(False)), F.coalesce(rule["rename"], token)
                )
                same = either(rule["rename"].isNull(), word, self.word(rule["rename"]))
                return let(
                    F.struct(out.alias("token"), same.alias("word")),
                    lambda left: self._place(state, token, rule, left),
                )

            return let(self.first_rule(word["token_rules"], state), placement)

        return let(self.word(token), after_token_rule)

    def _place(self, state: Column, token: Column, rule: Column, left: Column) -> Column:
        out, word = left["token"], left["word"]

        def held(column: Column) -> Column:
            return F.get(F.array(*[state["tags"][field] for field in _TAG_FIELDS]), column)

        def with_column(column: Column) -> Column:
            # A full column refuses the token, unless it holds the same one.
            fits = either(
                out.isNotNull() & column.isNotNull(), F.coalesce(held(column) == out, F.lit(True)), F.lit(False)
            )

            def with_place(place: Column) -> Column:
                sub = either(out.isNotNull() & place.isNull(), self.first_rule(word["subtype_rules"], state))
                return let(sub, lambda s: self._update(state, token, rule, out, place, s))

            return let(either(fits, column), with_place)

        return let(self.column_of(word), with_column)

    def _update(
        self, state: Column, token: Column, rule: Column, out: Column, place: Column, sub: Column
    ) -> Column:
        """The state after the token: what its rules overwrite, its place, its sub-types."""
        basic_type = either(
            rule["self"], token, F.coalesce(rule["retype"], sub["retype"], state["bt"])
        )
        no_more = out.isNull() | place.isNotNull() | F.coalesce(sub["drop"], F.lit(False))
        own = either(~no_more, F.array(F.coalesce(sub["rename"], out)))
        add = F.coalesce(rule["add"], sub["add"], own)
        front = F.coalesce(rule["front"] & rule["add"].isNotNull(), F.lit(False)) | F.coalesce(
            sub["front"], F.lit(False)
        )
        more = either(front, F.array_union(add, state["st"]), F.array_union(state["st"], add))
        subtypes = either(add.isNull(), state["st"], more)
        changed = F.struct(
            *[
                either(place == i, out, F.coalesce(rule["tags"][field], state["tags"][field])).alias(field)
                for i, field in enumerate(_TAG_FIELDS)
            ]
        )
        tags = either(place.isNull() & rule["tags"].isNull(), state["tags"], changed)
        return F.struct(
            state["route"].alias("route"),
            basic_type.alias("bt"),
            subtypes.alias("st"),
            tags.alias("tags"),
            state["cats"].alias("cats"),
        )


def fold_tokens(tokens: Column, group: Column, category: Column, primary: Column, rules: RuleSet):
    """The state of a row after all its resolved tokens."""
    # Meals are tagged by their primary category.
    gate = F.when(category == "Meals", primary).otherwise(category)

    fold = _Fold(group, category, gate, rules)

    def run(tokens: Column) -> Column:
        rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
        start = let(tokens.getItem(0), lambda first: initial_state(first, rules))
        return F.aggregate(rest, start, fold.step)

    return let(tokens, run)


def row_state(rules: RuleSet, tokens: str | None = None) -> Column:
    """The state of each row, by its route: non-food, product-type override, or fold.

    ``tokens`` names a column with tokens that have been resolved already."""
    # Expressions live in the JVM they were built in, which an application has for itself.
    application = SparkContext.getOrCreate().applicationId
    key = (application, tokens)
    if key not in rules.compiled:
        for old in [k for k in rules.compiled if k[0] != application]:
            del rules.compiled[old]
        rules.compiled[key] = _row_state(rules, tokens)
    return rules.compiled[key]


def _row_state(rules: RuleSet, tokens: str | None) -> Column:
    product_type, name = F.col(S.quoted(S.PRODUCT_TYPE)), F.col(S.quoted(S.PRODUCT_NAME))
    group, category, primary = (F.col(S.quoted(c)) for c in S.CATEGORY_LABELS)
    overrides = {k: _state_literal(v, "override") for k, v in rules.overrides.items()}
    non_food = constant(_state_literal({}, "non-food"), _STATE_DDL)
    state = F.when(category == NON_FOOD, non_food)
    if overrides:
        state = state.when(
            product_type.isin(list(overrides)),
            lookup(product_type, overrides, _STATE_DDL),
        )
    resolved = split_tokens(name, rules) if tokens is None else F.col(S.quoted(tokens))
    return state.otherwise(fold_tokens(resolved, group, category, primary, rules))


# --- after the fold ------------------------------------------------------------------------------


def correct_row(df: DataFrame) -> DataFrame:
    """Repairs of mislabeled rows, which look at the finished row."""
    bt, st = F.col("bt"), F.col("st")
    group, category, primary = (F.col(S.quoted(c)) for c in S.CATEGORY_LABELS)
    folded = F.col("route") == "fold"
    condiments = F.lit("Condiments & Snacks")

    spice = folded & (bt == "spice") & ~group.eqNullSafe(condiments)
    chili_spice = folded & (bt == "chili") & (group == condiments)
    chili_pepper = folded & (bt == "chili") & (group == "Produce")
    bologna = (
        folded
        & (bt == "bologna")
        & F.lower(F.col(S.quoted(S.PRODUCT_TYPE))).contains("all")
    )
    chickpea = (
        folded
        & (bt == "chickpea")
        & F.lower(F.col(S.quoted(S.PRODUCT_NAME))).contains("roasted")
    )
    energy = folded & (bt == "beverage") & (F.get(st, F.lit(0)) == "energy drink")

    def front(word: str) -> Column:
        return F.array_union(F.array(F.lit(word)), st)

    return df.withColumns(
        {
            "bt": F.when(chili_spice, "spice")
            .when(chili_pepper, "pepper")
            .when(bologna, "beef")
            .when(chickpea, "snack")
            .when(energy, "energy drink")
            .otherwise(bt),
            "st": F.when(chili_spice | chili_pepper, front("chili"))
            .when(bologna, F.array(F.lit("pork"), F.lit("bologna")))
            .when(chickpea, front("chickpea"))
            .when(energy, F.array_remove(st, "energy drink"))
            .otherwise(st),
            S.FPG: F.when(spice, condiments).otherwise(group),
            S.FPC: F.when(spice, condiments).when(bologna, "Beef").otherwise(category),
            S.PFPC: F.when(bologna, "Beef").otherwise(primary),
        }
    )


def collapse_subtypes(subtypes: Column, category: Column, rules: RuleSet) -> Column:
    """Several sub-types of one kind become one word; then variety and blend go first."""
    kind_of: dict[str, str] = {}
    for kind in COLLAPSE_ORDER:
        for word in rules.vocabularies[kind]:
            kind_of.setdefault(word, kind)

    def change(sorted_out: Column, kind: str, word: Column) -> Column:
        found = F.transform(
            F.filter(sorted_out, lambda pair: pair["kind"] == kind), lambda pair: pair["word"]
        )
        return let(
            found,
            lambda f: either(
                F.size(f) > 1,
                F.struct(f.alias("out"), F.array(word).alias("into")),
                F.struct(_empty().alias("out"), _empty().alias("into")),
            ),
        )

    pairs = F.transform(
        subtypes, lambda s: F.struct(s.alias("word"), lookup(s, kind_of, "string").alias("kind"))
    )
    into = {kind: F.lit(word) for kind, word in COLLAPSE.items()}
    into["fruits"] = F.when(category == "Fruit", "blend").otherwise(into["fruits"])

    def collapsed(p: Column) -> Column:
        """The sub-types without repeats; only where two have one kind, that is worked out kind by kind."""
        found = F.array_compact(F.transform(p, lambda pair: pair["kind"]))
        changes = F.array(*[change(p, kind, word) for kind, word in into.items()])
        return either(
            let(found, lambda f: F.size(F.array_distinct(f)) == F.size(f)),
            F.array_distinct(subtypes),
            let(changes, rebuild),
        )

    def rebuild(changes: Column) -> Column:
        out = F.flatten(F.transform(changes, lambda c: c["out"]))
        into = F.flatten(F.transform(changes, lambda c: c["into"]))
        return F.array_except(F.array_union(subtypes, into), out)

    def order(result: Column) -> Column:
        ahead = F.array(F.lit("variety"), F.lit("blend"))
        first = F.filter(ahead, lambda w: F.array_contains(result, w))
        return either(F.arrays_overlap(result, ahead), F.array_union(first, result), result)

    return either(F.size(subtypes) < 2, subtypes, let(let(pairs, collapsed), order))


def without_repeats(values: Column) -> Column:
    """An array with each value that already occurred further left set to null.

    Places are looked for only in arrays that hold a value twice, which distinct values tell."""

    def changed(row: Column) -> Column:
        return F.transform(row, lambda value, i: either(F.array_position(row, value) == i + 1, value))

    def unique(row: Column) -> Column:
        return let(F.array_compact(row), lambda held: F.size(F.array_distinct(held)) == F.size(held))

    return let(values, lambda row: either(unique(row), row, changed(row)))


def combined_name(columns: list[str]) -> Column:
    """The values that are present, joined by a comma."""
    return F.concat_ws(", ", *[F.col(S.quoted(c)) for c in columns])


def normalize_rows(df: DataFrame, rules: RuleSet, tokens: str | None = None) -> DataFrame:
    """Normalize cleaned purchase rows; see :func:`normalize`."""
    compile_wide_rows(df.sparkSession)
    taken = {*S.NORMALIZED_COLUMNS, S.SUB_TYPES, S.MISC, S.NORMALIZED_NAME, tokens}
    kept = [c for c in df.columns if c not in taken]
    # ``inline`` of a one-element array computes the state once per row. A struct column would be
    # computed again by every filter that Spark pushes below the projection.
    state = df.select(*[F.col(S.quoted(c)) for c in kept], F.inline(F.array(row_state(rules, tokens))))
    state = state.withColumns(
        {
            title: F.coalesce(F.col(f"cats.{f}"), F.col(S.quoted(title)))
            for f, title in zip(_CATEGORY_FIELDS, S.CATEGORY_LABELS)
        }
    )
    state = correct_row(state)
    folded = F.col("route") == "fold"
    state = state.withColumn(
        "st",
        F.when(
            folded, collapse_subtypes(F.col("st"), F.col(S.quoted(S.FPC)), rules)
        ).otherwise(F.col("st")),
    )
    values = F.array(
        F.col("bt"),
        *[F.get(F.col("st"), F.lit(i)) for i in range(len(S.SUB_TYPE_COLUMNS))],
        *[F.col(f"tags.{f}") for f in _TAG_FIELDS],
    )
    row = F.struct(
        F.when(folded, without_repeats(values)).otherwise(values).alias("values"),
        F.col("st"),
        F.when(
            F.col("route") != "non-food",
            F.slice(F.col("st"), F.lit(4), F.greatest(F.size("st"), F.lit(1))),
        ).alias("misc"),
    )
    row = state.select(*[F.col(S.quoted(c)) for c in kept], F.inline(F.array(row)))
    return row.select(
        *[F.col(S.quoted(c)) for c in kept],
        *[F.get(F.col("values"), F.lit(i)).alias(c) for i, c in enumerate(S.NORMALIZED_COLUMNS)],
        F.col("st").alias(S.SUB_TYPES),
        F.col("misc").alias(S.MISC),
        F.array_join("values", ", ").alias(S.NORMALIZED_NAME),
    )


def normalize(
    df: DataFrame,
    rules: RuleSet | None = None,
    *,
    distinct_first: bool = False,
    tokens: str | None = None,
) -> DataFrame:
    """Add the 17 normalized columns, ``Sub-Types``, ``Misc`` and ``Normalized Name``.

    ``df`` holds cleaned rows with the five group columns; other columns pass through.

    ``distinct_first`` normalizes each distinct combination of the group columns once and joins
    the result back. It pays only where names repeat very often and the rule pack is slow: the
    direct way needs no shuffle at all.

    ``tokens`` names a column with the tokens of the names, resolved by ``corrections.with_tokens``, for
    corrections that are too many for the plan; it is not kept.
    """
    rules = rules or RuleSet.starter()
    if not distinct_first:
        return normalize_rows(df, rules, tokens)
    if tokens is not None:
        raise RuleError("resolved tokens go with the direct way only")
    columns = [*S.GROUP_COLUMNS, *S.NORMALIZED_COLUMNS, S.SUB_TYPES, S.MISC]
    lists = {S.SUB_TYPES: "array<string>", S.MISC: "array<string>"}
    groups = {c: df.schema[c].dataType.simpleString() for c in S.GROUP_COLUMNS}
    # The group columns are wide, so rows find theirs by a digest, and text goes along as one value.
    keys = df.select(packed(groups).alias("_packed")).distinct()
    keys = unpacked(keys.select(_digest(F.col("_packed")), "_packed"), "_packed", groups)
    done = normalize_rows(keys, rules).select("_digest", packed(columns).alias("_packed"))
    rest = [F.col(S.quoted(c)) for c in df.columns if c not in S.GROUP_COLUMNS]
    joined = df.select(*rest, _digest(packed(groups))).join(done, "_digest").select(*rest, "_packed")
    rows = unpacked(joined, "_packed", {c: lists.get(c) or groups.get(c, "string") for c in columns})
    order = [F.col(S.quoted(c)) for c in [*df.columns, *columns[len(groups) :]]]
    return rows.select(*order, combined_name(S.NORMALIZED_COLUMNS).alias(S.NORMALIZED_NAME))


def _digest(value: Column) -> Column:
    """``_digest``: 128 bits of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16).alias("_digest")
