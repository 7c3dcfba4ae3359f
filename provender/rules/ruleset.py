"""The rule pack: every table and rule the normalization reads, checked once on load."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from provender import schema as S
from provender.errors import RuleError
from provender.rules import conditional, fixed_values as V
from provender.rules.conditional import Rule

# A rule pack is written by people and travels inside the query plan, so it has to stay small.
MAX_TABLE_ROWS = 20_000

TAG_SCOPINGS = ("cumulative", "isolated")


def close_corrections(corrections: Mapping[str, str]) -> dict[str, str]:
    """Follow chains of corrections to their end, so that one lookup is enough."""
    closed = {}
    for raw in corrections:
        seen, word = {raw}, corrections[raw]
        while word in corrections:
            if word in seen:
                raise RuleError(f"corrections form a cycle at {word!r}")
            seen.add(word)
            word = corrections[word]
        closed[raw] = word
    return closed


def category_groups(hierarchy: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Category -> group. A category listed twice keeps its first place and its last group."""
    return {category: group for group, members in hierarchy.items() for category in members}


def tag_gates(
    hierarchy=V.HIERARCHY,
    scopes=V.TAG_SCOPES,
    private=V.PRIVATE_SCOPES,
    scoping: str = "cumulative",
) -> dict[str, dict[str, str]]:
    """Category -> {tag: column}, the tags that go to a column instead of the sub-types.

    ``isolated``: a category takes the tags of scope "All", of its group and its own.
    ``cumulative``: it also takes what the categories before it, in hierarchy order, have added.
    The columns of ``private`` groups start from the shared tags but add nothing to them.
    """
    if scoping not in TAG_SCOPINGS:
        raise RuleError(f"tag_scoping must be one of {TAG_SCOPINGS}, not {scoping!r}")
    shared = {column: set(tags) for column, tags in scopes["All"].items()}
    gates: dict[str, dict[str, str]] = {}
    for category, group in category_groups(hierarchy).items():
        gate: dict[str, str] = {}
        for column in shared:
            own = set(scopes.get(group, {}).get(column, ()))
            own |= set(scopes.get(category, {}).get(column, ()))
            start = shared[column] if scoping == "cumulative" else set(scopes["All"][column])
            if column in private.get(group, {}):
                allowed = (start - set(private[group][column])) | own
            else:
                allowed = start | own
                shared[column] = allowed if scoping == "cumulative" else shared[column]
            for tag in sorted(allowed):
                if gate.setdefault(tag, column) != column:
                    raise RuleError(f"tag {tag!r} is in two columns of {category!r}")
        gates[category] = gate
    return gates


@dataclass(frozen=True)
class RuleSet:
    corrections: dict[str, str]
    skipped: tuple[str, ...]
    vocabularies: dict[str, tuple[str, ...]]
    type_map: dict[str, dict]
    overrides: dict[str, dict]
    hierarchy: dict[str, list[str]]
    gates: dict[str, dict[str, str]]
    token_rules: tuple[Rule, ...]
    subtype_rules: tuple[Rule, ...]
    unplaced_tags: dict[str, list[str]] = field(default_factory=dict)
    # Expressions built from this pack, kept because building one takes a second.
    compiled: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def starter(cls, tag_scoping: str = "cumulative") -> "RuleSet":
        """The pack of ``fixed_values``."""
        return cls.build(tag_scoping=tag_scoping)

    @classmethod
    def build(
        cls,
        *,
        corrections: Mapping[str, str] | None = None,
        skipped: Iterable[str] | None = None,
        vocabularies: Mapping[str, Iterable[str]] | None = None,
        type_map: Mapping[str, dict] | None = None,
        overrides: Mapping[str, dict] | None = None,
        tag_scopes: Mapping[str, Mapping[str, Iterable[str]]] | None = None,
        token_rules: Iterable[Rule] | None = None,
        subtype_rules: Iterable[Rule] | None = None,
        hierarchy: Mapping[str, Iterable[str]] | None = None,
        tag_scoping: str = "cumulative",
    ) -> "RuleSet":
        """A pack from Python values; every table left out is the starter's."""
        hierarchy = V.HIERARCHY if hierarchy is None else hierarchy
        lists = {"flavors": V.FLAVORS, **V.VOCABULARIES, **(vocabularies or {})}
        skipped = tuple(V.SKIPPED if skipped is None else skipped)
        lists["skipped"] = skipped
        lists["all_flavors"] = list(dict.fromkeys([*lists["flavors"], *lists["fruits"]]))
        pack = cls(
            corrections=close_corrections(V.CORRECTIONS if corrections is None else corrections),
            skipped=skipped,
            vocabularies={name: tuple(words) for name, words in lists.items()},
            type_map=dict(V.TYPE_MAP if type_map is None else type_map),
            overrides=dict(V.PRODUCT_TYPE_OVERRIDES if overrides is None else overrides),
            hierarchy={g: list(c) for g, c in hierarchy.items()},
            gates=tag_gates(hierarchy, scopes=tag_scopes or V.TAG_SCOPES, scoping=tag_scoping),
            token_rules=tuple(
                conditional.TOKEN_RULES if token_rules is None else token_rules
            ),
            subtype_rules=tuple(
                conditional.subtype_rules(
                    V.SUBTYPE_VALUES, V.SUBTYPE_EXPANSIONS, V.FRONT_EXPANSIONS, V.CEREAL_GRAINS
                )
                if subtype_rules is None
                else subtype_rules
            ),
            unplaced_tags=dict(conditional.UNPLACED_TAGS),
        )
        pack.validate()
        return pack

    @classmethod
    def from_directory(
        cls,
        spark: SparkSession,
        path: str,
        tag_scoping: str = "cumulative",
        *,
        corrections: bool = True,
    ) -> "RuleSet":
        """Read a pack from CSV tables with a header, all under one directory.

        ``corrections(raw, clean)``, ``skipped(token)``, ``vocabularies(list, token)``,
        ``types(type, column, value)``, ``overrides(product_type, column, value)``,
        ``tag_scopes(scope, column, tag)``, ``hierarchy(group, category)``. Several rows with column
        ``Sub-Types`` list the sub-types in order. The conditional rules are lines of JSON in
        ``token_rules.json`` and ``subtype_rules.json``, a rule a line, in order. A table that is
        not there is the starter's; :meth:`to_directory` writes them all. ``corrections=False`` leaves
        that table out, for names whose tokens are resolved by ``operators.corrections``.
        """
        tables = {
            name: _rule_table(spark, path, name, columns)
            if corrections or name != "corrections"
            else None
            for name, columns in {
                "corrections": ["raw", "clean"],
                "skipped": ["token"],
                "vocabularies": ["list", "token"],
                "types": ["type", "column", "value"],
                "overrides": ["product_type", "column", "value"],
                "tag_scopes": ["scope", "column", "tag"],
                "hierarchy": ["group", "category"],
            }.items()
        }
        given: dict = {"tag_scoping": tag_scoping}
        if not corrections:
            given["corrections"] = {}
        elif tables["corrections"] is not None:
            given["corrections"] = dict(tables["corrections"])
        if tables["skipped"] is not None:
            given["skipped"] = [token for (token,) in tables["skipped"]]
        if tables["vocabularies"] is not None:
            lists: dict[str, list[str]] = {}
            for name, token in tables["vocabularies"]:
                lists.setdefault(name, []).append(token)
            given["vocabularies"] = lists
        for table, argument in (("types", "type_map"), ("overrides", "overrides")):
            if tables[table] is not None:
                given[argument] = _assignments(tables[table])
        if tables["tag_scopes"] is not None:
            scopes: dict = {"All": {column: [] for column in S.TAG_COLUMNS}}
            for scope, column, tag in tables["tag_scopes"]:
                scopes.setdefault(scope, {}).setdefault(column, []).append(tag)
            given["tag_scopes"] = scopes
        if tables["hierarchy"] is not None:
            groups: dict[str, list[str]] = {}
            for group, category in tables["hierarchy"]:
                groups.setdefault(group, []).append(category)
            given["hierarchy"] = groups
        for name in ("token_rules", "subtype_rules"):
            lines = _rule_lines(spark, path, name)
            if lines is not None:
                given[name] = [conditional.rule_from_dict(json.loads(line)) for line in lines]
        return cls.build(**given)

    def to_directory(self, spark: SparkSession, path: str, tag_scopes=V.TAG_SCOPES) -> None:
        """Write the pack as the tables that :meth:`from_directory` reads."""
        lists = {k: v for k, v in self.vocabularies.items() if k not in ("skipped", "all_flavors")}
        tables = {
            "corrections": (["raw", "clean"], self.corrections.items()),
            "skipped": (["token"], [(w,) for w in self.skipped]),
            "vocabularies": (["list", "token"], [(k, w) for k, v in lists.items() for w in v]),
            "types": (["type", "column", "value"], _rows_of(self.type_map)),
            "overrides": (["product_type", "column", "value"], _rows_of(self.overrides)),
            "tag_scopes": (
                ["scope", "column", "tag"],
                [(s, c, t) for s, columns in tag_scopes.items() for c, tags in columns.items() for t in tags],
            ),
            "hierarchy": (["group", "category"], [(g, c) for g, v in self.hierarchy.items() for c in v]),
        }
        for name, (columns, rows) in tables.items():
            schema = ", ".join(f"`{c}` string" for c in columns)
            (
                spark.createDataFrame(list(rows), schema)
                .coalesce(1)
                .write.mode("overwrite")
                .option("header", True)
                .option("quote", '"')
                .option("escape", '"')
                .csv(f"{path.rstrip('/')}/{name}.csv")
            )
        for name, rules in (("token_rules", self.token_rules), ("subtype_rules", self.subtype_rules)):
            lines = [(json.dumps(conditional.rule_to_dict(r), ensure_ascii=False),) for r in rules]
            frame = spark.createDataFrame(lines, "value string").coalesce(1)
            frame.write.mode("overwrite").text(f"{path.rstrip('/')}/{name}.json")

    def with_rules(self, **changes) -> "RuleSet":
        """A copy with some fields changed, checked again."""
        pack = replace(self, compiled={}, **changes)
        pack.validate()
        return pack

    @property
    def category_groups(self) -> dict[str, str]:
        return category_groups(self.hierarchy)

    @property
    def all_tags(self) -> list[str]:
        return sorted({tag for gate in self.gates.values() for tag in gate})

    def validate(self) -> None:
        sizes = {
            "corrections": len(self.corrections),
            "types": len(self.type_map),
            "overrides": len(self.overrides),
            **{name: len(words) for name, words in self.vocabularies.items()},
        }
        for name, size in sizes.items():
            if size > MAX_TABLE_ROWS:
                raise RuleError(f"{name} has {size} rows, more than {MAX_TABLE_ROWS}")
        for rule in (*self.token_rules, *self.subtype_rules):
            for when in rule.when:
                if not when.tokens and not when.lists:
                    raise RuleError(f"rule {rule.name!r} has a condition without tokens")
                unknown = set(when.lists + when.type_lists) - set(self.vocabularies)
                if unknown:
                    raise RuleError(f"rule {rule.name!r} names unknown lists {sorted(unknown)}")
            if set(rule.assign) - set(S.TAG_COLUMNS):
                raise RuleError(f"rule {rule.name!r} assigns columns that are not tag columns")
        for key, row in {**self.type_map, **self.overrides}.items():
            known = {*S.NORMALIZED_COLUMNS, *S.CATEGORY_LABELS, S.SUB_TYPES}
            if set(row) - known:
                raise RuleError(f"{key!r} assigns unknown columns {sorted(set(row) - known)}")

    def ruled_tokens(self, rules: Iterable[Rule]) -> list[str]:
        """Every token that some rule of the table mentions."""
        words: dict[str, None] = {}
        for rule in rules:
            for when in rule.when:
                words.update(dict.fromkeys(when.tokens))
                for name in when.lists:
                    words.update(dict.fromkeys(self.vocabularies[name]))
        return list(words)


def _rule_table(spark, path, name, columns):
    from provender.sources.readers import path_exists

    table_path = f"{path.rstrip('/')}/{name}.csv"
    if not path_exists(spark, table_path):
        return None
    rows = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(table_path)
        .select(*columns)
        .limit(MAX_TABLE_ROWS + 1)
        .collect()
    )
    if len(rows) > MAX_TABLE_ROWS:
        raise RuleError(f"rule table {table_path} has more than {MAX_TABLE_ROWS} rows")
    return [tuple(row) for row in rows]


def _rule_lines(spark, path, name) -> list[str] | None:
    from provender.sources.readers import path_exists

    table_path = f"{path.rstrip('/')}/{name}.json"
    if not path_exists(spark, table_path):
        return None
    rows = spark.read.text(table_path).limit(MAX_TABLE_ROWS + 1).collect()
    if len(rows) > MAX_TABLE_ROWS:
        raise RuleError(f"rule table {table_path} has more than {MAX_TABLE_ROWS} rows")
    return [row["value"] for row in rows if row["value"].strip()]


def _rows_of(assignments: Mapping[str, dict]) -> list[tuple]:
    """The opposite of :func:`_assignments`; a key without values has a row without column."""
    rows: list[tuple] = []
    for key, row in assignments.items():
        if not row:
            rows.append((key, None, None))
        for column, value in row.items():
            values = value if isinstance(value, (list, tuple)) else [value]
            rows += [(key, column, v) for v in values]
    return rows


def _assignments(rows) -> dict[str, dict]:
    result: dict[str, dict] = {}
    for key, column, value in rows:
        target = result.setdefault(key, {})
        if column is None:
            continue
        if column == S.SUB_TYPES:
            target.setdefault(column, []).append(value)
        else:
            target[column] = value
    return result
