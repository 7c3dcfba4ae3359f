"""SQL for every registered query, for a check in another engine on the same tables."""

from __future__ import annotations

from provender import schema as S
from provender.plans import scores
from provender.plans import oracle_normalize as O
from provender.plans.oracle_normalize import (
    CLEAN_CTES,
    EXPORT_FIELDS,
    FULL_CTES,
    GATE_CTES,
    NORMALIZED_FIELDS,
    TOKEN_CTES,
    WHITE,
    named,
    one_of,
    rows,
    strings,
    text,
)
from provender.rules import fixed_values as V

_GROUPS = named(["pt", "pn", "fpg", "fpc", "pfpc"], S.GROUP_COLUMNS)
_FULL_ROW = (
    f'uid AS "Unique Id", {EXPORT_FIELDS}, array_to_string(stf, \'|\') AS "Sub-Types", '
    'array_to_string(misc, \'|\') AS "Misc", name AS "Normalized Name"'
)
_ISOLATED = FULL_CTES.replace("LEFT JOIN gate g", "LEFT JOIN isolated_gate g")

_ORACLE: dict[str, str] = {}

# --- sources and cleaning ------------------------------------------------------------------------

_ORACLE["load_purchases"] = f"""{CLEAN_CTES}
SELECT uid AS "Unique Id", origin AS "Origin Detail",
       {named(["pt0", "pn0", "fpg0", "fpc0", "pfpc0"], S.GROUP_COLUMNS)} FROM loaded"""

_ORACLE["clean_rows"] = f"""{CLEAN_CTES}
SELECT row_id, uid AS "Unique Id", origin AS "Origin Detail", {_GROUPS} FROM cleaned"""

_ORACLE["build_name"] = f"""{FULL_CTES}
SELECT uid AS "Unique Id", name AS "Product Name" FROM named"""

_ORACLE["fill_group"] = f"""{CLEAN_CTES}, {O.HIERARCHY}
SELECT uid AS "Unique Id", fpc0 AS "Food Product Category", h.fpg AS "Food Product Group"
FROM loaded LEFT JOIN hierarchy h ON h.fpc = fpc0"""

_ORACLE["group_commodity"] = f"""{CLEAN_CTES}, {O.HIERARCHY}
SELECT uid AS "Unique Id", fpc0 AS "Food Product Category", h.fpg AS "Food Product Group",
       NULL::VARCHAR AS "Commodity"
FROM raw_purchases LEFT JOIN hierarchy h ON h.fpc = fpc0"""

_ORACLE["smoke_rows"] = f"""{CLEAN_CTES}
SELECT row_id, uid AS "Unique Id", pn0 AS "Product Name" FROM loaded ORDER BY row_id LIMIT 1000"""

# --- normalization -------------------------------------------------------------------------------

_ORACLE["token_clean"] = f"""{TOKEN_CTES}
SELECT uid AS "Unique Id", (pos - 1)::INTEGER AS pos, tok AS token
FROM token JOIN cleaned USING (nid)"""

_ORACLE["token_clean_joined"] = _ORACLE["token_clean"]

_CLOSED = """
WITH RECURSIVE corrections AS (
    SELECT 'order ' || o_orderkey AS raw, 'order ' || (o_orderkey // 2) AS clean FROM orders
    WHERE o_orderkey > 0),
chain AS (
    SELECT raw, clean, 0 AS depth FROM corrections
    UNION ALL
    SELECT chain.raw, next.clean, depth + 1 FROM chain JOIN corrections next ON chain.clean = next.raw),
closed AS (SELECT raw, arg_max(clean, depth) AS clean FROM chain GROUP BY raw)"""

_ORACLE["corrections_closed"] = f"{_CLOSED} SELECT raw, clean FROM closed"

_ORACLE["token_clean_orders"] = f"""{_CLOSED}
SELECT l_orderkey || '-' || l_linenumber AS line,
       coalesce(clean, 'order ' || l_orderkey) || '|part ' || l_partkey AS tokens
FROM lineitem LEFT JOIN closed ON raw = 'order ' || l_orderkey"""

_ORACLE["quoted_csv_rows"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, '"' || source || '",' || chr(10) || '"' || text AS remark, lang,
       row_number() OVER (ORDER BY doc_id) - 1 AS ordinal
FROM documents"""

_ORACLE["type_map_first"] = f"""{TOKEN_CTES}
SELECT uid AS "Unique Id", coalesce(m.bt, tok) AS "Basic Type",
       coalesce(array_to_string(m.st, '|'), '') AS "Sub-Types", m.c1 AS "Shape",
       m.c4 AS "Processing", m.c9 AS "Dietary Accommodation"
FROM token t JOIN cleaned USING (nid) LEFT JOIN type_map m ON m.key = tok WHERE pos = 1"""

for _name, _table in (("cumulative", "gate"), ("isolated", "isolated_gate")):
    _ORACLE[f"tag_gate_{_name}"] = f"""{GATE_CTES}
SELECT tagcat AS category, tok AS token, g.col AS "column", count(*) AS n
FROM token LEFT JOIN {_table} g ON g.fpc = tagcat AND g.tag = tok GROUP BY ALL"""

_ORACLE["normalize_names"] = f"{FULL_CTES} SELECT {_FULL_ROW} FROM named"
_ORACLE["normalize_distinct_first"] = _ORACLE["normalize_names"]
_ORACLE["normalize_joined"] = _ORACLE["normalize_names"]
_ORACLE["normalize_isolated"] = f"{_ISOLATED} SELECT {_FULL_ROW} FROM named"
_ORACLE["normalize_override"] = f"""{FULL_CTES}
SELECT {_FULL_ROW} FROM named WHERE route = 'override'"""
_ORACLE["normalize_nonfood"] = f"""{FULL_CTES}
SELECT {_FULL_ROW} FROM named WHERE route = 'non-food'"""


def _kind(kind: str, earlier: list[str]) -> str:
    words = strings(V.VOCABULARIES[kind])
    before = strings([w for k in earlier for w in V.VOCABULARIES[k]])
    return (
        f"list_filter(st, lambda x: list_contains({words}, x) AND NOT list_contains({before}, x))"
    )


_ORACLE["subtype_collapse"] = f"""{TOKEN_CTES},
ordered AS (
  SELECT nid, tok, min(pos) AS pos FROM token WHERE pos > 1 GROUP BY nid, tok
),
sets AS (
  SELECT c.nid, c.uid, c.fpc, coalesce(list(o.tok ORDER BY o.pos) FILTER (o.tok IS NOT NULL),
         []::VARCHAR[]) AS st
  FROM folded_rows f JOIN cleaned c USING (nid) LEFT JOIN ordered o USING (nid)
  GROUP BY c.nid, c.uid, c.fpc
),
found AS (
  SELECT *, {_kind("fruits", [])} AS fr, {_kind("cheeses", ["fruits"])} AS ch,
         {_kind("melons", ["fruits", "cheeses", "vegetables"])} AS me
  FROM sets
),
items AS (
  SELECT nid, x, 0 AS part, i FROM (
    SELECT nid, unnest(st) AS x, generate_subscripts(st, 1) AS i, fr, ch, me FROM found)
  WHERE NOT (len(fr) > 1 AND list_contains(fr, x)) AND NOT (len(ch) > 1 AND list_contains(ch, x))
    AND NOT (len(me) > 1 AND list_contains(me, x))
  UNION ALL SELECT nid, CASE WHEN fpc = 'Fruit' THEN 'blend' ELSE 'fruit' END, 1, 1
    FROM found WHERE len(fr) > 1
  UNION ALL SELECT nid, 'blend', 1, 2 FROM found WHERE len(ch) > 1
  UNION ALL SELECT nid, 'variety', 1, 3 FROM found WHERE len(me) > 1
),
placed AS (
  SELECT nid, x, min(CASE x WHEN 'variety' THEN -2 WHEN 'blend' THEN -1 ELSE part * 1000 + i END)
         AS place
  FROM items GROUP BY nid, x
)
SELECT uid AS "Unique Id", coalesce(string_agg(x, '|' ORDER BY place), '') AS "Sub-Types"
FROM sets LEFT JOIN placed USING (nid) GROUP BY nid, uid"""

_ORACLE["column_dedupe"] = f"""{TOKEN_CTES},
all_tokens AS (SELECT nid, list(tok ORDER BY pos) AS toks FROM token GROUP BY nid),
all_values AS (
  SELECT uid, [c.fpg, c.fpc, c.pfpc] || coalesce(toks, []::VARCHAR[]) AS v
  FROM folded_rows JOIN cleaned c USING (nid) LEFT JOIN all_tokens USING (nid)
),
placed AS (SELECT uid, v, unnest(generate_series(1, len(v))) AS i FROM all_values)
SELECT uid AS "Unique Id", (i - 1)::INTEGER AS pos,
       CASE WHEN list_position(v, v[i]) = i THEN v[i] END AS value
FROM placed"""

# --- reports -------------------------------------------------------------------------------------

_ORACLE["normalized_name"] = f"""{FULL_CTES}
SELECT uid AS "Unique Id", name AS "Normalized Name" FROM named"""

_ORACLE["name_diff"] = f"""{FULL_CTES}
SELECT pt AS "Product Type", pn AS self, name AS other FROM named
WHERE pn IS DISTINCT FROM name"""

_LIST_TEXT = """'[' || array_to_string(list_transform(misc, lambda x:
  CASE WHEN contains(x, '''') THEN '"' || x || '"' ELSE '''' || x || '''' END), ', ') || ']'"""
_ORACLE["misc_overflow"] = f"""{FULL_CTES}
SELECT {named(["pt", "pn", "fpg", "fpc", "v0", "v1", "v2", _LIST_TEXT], S.MISC_EXPORT_COLUMNS)}
FROM named WHERE misc IS NULL OR len(misc) > 0"""

_ORACLE["scoring_export"] = f"""{FULL_CTES}
SELECT uid AS "Unique Id", origin AS "Producer/Processor",
       {named(["pt", "fpg", "fpc", "pfpc", "name", *O._V], S.EXPORT_COLUMNS)} FROM named"""

_ORACLE["normalized_export"] = f"{FULL_CTES} SELECT {EXPORT_FIELDS} FROM named"

_LONG = f"""{FULL_CTES},
wide AS (SELECT {EXPORT_FIELDS} FROM named),
long AS (
  SELECT CASE WHEN name LIKE 'Sub-Type %' THEN 'Sub-Types' ELSE name END AS "column", value
  FROM (UNPIVOT wide ON COLUMNS(*) INTO NAME name VALUE value)
)"""
_ORACLE["value_counts"] = f"""{_LONG}
SELECT "column", value, count(*) AS count FROM long GROUP BY ALL"""

_SHEETS = [c for c in S.EXPORT_COLUMNS if c not in S.SUB_TYPE_COLUMNS]
_SHEETS = _SHEETS[:6] + ["Sub-Types"] + _SHEETS[6:]
_ORACLE["value_count_sheets"] = f"""{_LONG}
SELECT (list_position({strings(_SHEETS)}, "column") - 1)::INTEGER AS column_pos,
       "column", value, count(*) AS count FROM long GROUP BY ALL"""

_ORACLE["subtype_counts"] = f"""{FULL_CTES}
SELECT x AS value, count(*) AS count
FROM (SELECT unnest([v1, v2, v3]) AS x FROM named) WHERE x IS NOT NULL GROUP BY x"""

# --- training tables -----------------------------------------------------------------------------

_SLOT = dict(zip(S.NORMALIZED_COLUMNS, O._V)) | {S.FPG: "fpg", S.FPC: "fpc", S.PFPC: "pfpc"}
_TRAINING = f"""{FULL_CTES},
training AS (
  SELECT nid, row_id, uid, pt AS "Product Type",
         {", ".join(f"coalesce({_SLOT[c]}, 'None') AS " + f'"{c}"' for c in S.LABELS)}
  FROM named
  WHERE pt IS NOT NULL AND fpg IS NOT NULL AND fpc IS NOT NULL AND pfpc IS NOT NULL
),
labels_wide AS (SELECT {", ".join(f'"{c}"' for c in S.LABELS)} FROM training),
labels_long AS (
  SELECT name AS "column", value AS label
  FROM (UNPIVOT labels_wide ON COLUMNS(*) INTO NAME name VALUE value)
),
counts AS (
  SELECT "column", label, count(*) AS count FROM labels_long GROUP BY ALL
  UNION ALL
  SELECT 'Sub-Types', label, count(*) FROM labels_long WHERE "column" LIKE 'Sub-Type %'
  GROUP BY label
),
label_index AS (
  SELECT "column", label,
         (row_number() OVER (PARTITION BY "column" ORDER BY label) - 1)::INTEGER AS index
  FROM counts WHERE "column" NOT LIKE 'Sub-Type _'
)"""
_ORACLE["training_rows"] = f"""{_TRAINING}
SELECT "Product Type", {", ".join(f'"{c}"' for c in S.LABELS)} FROM training"""

_ORACLE["dropped_counts"] = f"""{CLEAN_CTES},
reasons AS (
  SELECT CASE WHEN pt0 IS NULL THEN 'Product Type' WHEN fpg0 IS NULL THEN 'Food Product Group'
              WHEN fpc0 IS NULL THEN 'Food Product Category'
              WHEN pfpc0 IS NULL THEN 'Primary Food Product Category' END AS r
  FROM loaded
)
SELECT c AS "column", (SELECT count(*) FROM reasons WHERE r = c) AS dropped
FROM (SELECT unnest({strings(["Product Type", *S.CATEGORY_LABELS])}) AS c)"""

_ORACLE["train_union_dedupe"] = f"""{CLEAN_CTES},
both_files AS (
  SELECT 0 AS file_no, row_id, pt AS t, fpg, fpc, pfpc FROM cleaned
  UNION ALL SELECT 1, row_id, pn, fpg, fpc, pfpc FROM cleaned
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY file_no, row_id) AS rn FROM both_files
  WHERE t IS NOT NULL AND fpg IS NOT NULL AND fpc IS NOT NULL AND pfpc IS NOT NULL
)
SELECT file_no, row_id, {named(["t", "fpg", "fpc", "pfpc"], ["Product Type", *S.CATEGORY_LABELS])}
FROM numbered WHERE rn = 1"""

_ORACLE["class_counts"] = f'{_TRAINING} SELECT "column", label, count FROM counts'
_ORACLE["label_encode"] = f'{_TRAINING} SELECT "column", label, index FROM label_index'
_ORACLE["decoders"] = f"""{_TRAINING}
SELECT (list_position({strings(S.HEADS)}, "column") - 1)::INTEGER AS head_pos, "column", index,
       label FROM label_index"""
_ORACLE["inference_masks"] = f"""{_TRAINING}
SELECT DISTINCT "Food Product Group", "Basic Type" FROM training"""
_ORACLE["mask_vectors"] = f"""{_TRAINING},
types AS (SELECT label, index FROM label_index WHERE "column" = 'Basic Type'),
valid AS (SELECT DISTINCT "Food Product Group" AS g, "Basic Type" AS b FROM training),
cells AS (
  SELECT g, index, max((b = label)::INTEGER) AS bit FROM valid, types GROUP BY g, index
)
SELECT g AS "Food Product Group", string_agg(bit::VARCHAR, '' ORDER BY index) AS mask
FROM cells GROUP BY g"""


def _head(label: str) -> str:
    return S.SUB_TYPES if label in S.SUB_TYPE_COLUMNS else label


_ORACLE["encode_rows"] = (
    f"{_TRAINING} SELECT row_id, "
    + ", ".join(f'i{n}.index AS "{c}_index"' for n, c in enumerate(S.LABELS))
    + " FROM training t "
    + " ".join(
        f'LEFT JOIN label_index i{n} ON i{n}."column" = {text(_head(c))} AND i{n}.label = t."{c}"'
        for n, c in enumerate(S.LABELS)
    )
)
_ORACLE["encode_rows_joined"] = _ORACLE["encode_rows"]
_ORACLE["multi_hot"] = f"""{_TRAINING},
ones AS (
  SELECT DISTINCT t.nid, i.index
  FROM (SELECT nid, unnest(["Sub-Type 1", "Sub-Type 2", "Sub-Type 3"]) AS label FROM training) t
  JOIN label_index i ON i."column" = 'Sub-Types' AND i.label = t.label WHERE t.label <> 'None'
)
SELECT t.row_id, coalesce(string_agg(index::VARCHAR, '|' ORDER BY index), '') AS ones
FROM training t LEFT JOIN ones USING (nid) GROUP BY t.nid, t.row_id"""

# --- decoding ------------------------------------------------------------------------------------

_N = len(scores.CATEGORIES)


def _group_score(g: int, group: str) -> str:
    members = [scores.CATEGORIES.index(c) + 1 for c in V.HIERARCHY[group]]
    return f"greatest({', '.join(f'e[{m}]' for m in members)}, -1e9) + e[{55 + g}] * 0.25"


_TAGS = "(SELECT DISTINCT tag FROM (SELECT tag FROM gate UNION ALL SELECT tag FROM scope))"
_PLACES = rows(
    [text(label), str(n), str(counts[label])]
    for label in scores.SUB_TYPE_LABELS
    for n, counts in [
        next(
            (
                (n, c)
                for n, c in enumerate(scores.SUB_TYPE_COUNTS.values(), start=1)
                if label in c
            ),
            (0, {}),
        )
    ]
    if n
)
_MASK_ROWS = rows(
    [text(g), text(b)] for g, members in scores.decoder().masks.items() for b in members
)


def _head_cte(name: str, labels: list[str]) -> str:
    """Softmax and argmax of one head over exploded scores."""
    return f"""
{name}_long AS (
  SELECT vec_id, unnest({name}) AS s, generate_subscripts({name}, 1) AS i FROM raw_scores
),
{name}_soft AS (
  SELECT vec_id, i, ({strings(labels)})[i] AS label,
         exp(s - max(s) OVER (PARTITION BY vec_id))
           / sum(exp(s - m)) OVER (PARTITION BY vec_id) AS p
  FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM {name}_long)
)"""


def _best(name: str, source: str) -> str:
    return f"""
{name}_best AS (
  SELECT vec_id, label, p FROM {source}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) = 1
)"""


_HEADS = {
    "g": scores.GROUPS,
    "c": scores.CATEGORIES,
    "p": scores.CATEGORIES,
    "b": scores.BASIC_TYPES,
    "fr": scores.FROZEN,
    "pk": scores.PACKAGING,
}
_DECODE = (
    f"""WITH {O.HIERARCHY}, {O.TAG_GATE},
vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
),
raw_scores AS (
  SELECT vec_id,
    [{", ".join(_group_score(g, name) for g, name in enumerate(scores.GROUPS))}] AS g,
    e[1:{_N}] AS c,
    [{", ".join(f"e[{i}] + e[{_N + i}] * 0.5" for i in range(1, _N + 1))}] AS p,
    e[5:{4 + len(scores.BASIC_TYPES)}] AS b, e[60:61] AS fr, e[10:12] AS pk,
    e[20:{19 + len(scores.SUB_TYPE_LABELS)}] AS st
  FROM vec
),"""
    + ",".join(_head_cte(n, labels) for n, labels in _HEADS.items())
    + ","
    + ",".join(_best(n, f"{n}_soft") for n in ("g", "c", "p", "fr", "pk"))
    + f""",
valid(g, b) AS (SELECT * FROM {_MASK_ROWS}),
b_masked AS (
  SELECT s.vec_id, s.i, s.label, s.p * (v.b IS NOT NULL)::INTEGER AS p
  FROM b_soft s JOIN g_best t USING (vec_id) LEFT JOIN valid v ON v.g = t.label AND v.b = s.label
),{_best("b", "b_masked")},
joined AS (
  SELECT vec_id, g.label AS gl, c.label AS cl, p.label AS pl, b.label AS bl, b.p AS bp,
         fr.label AS frl, pk.label AS pkl,
         (g.label = 'Non-Food' OR c.label = 'Non-Food') AS nonfood,
         NOT EXISTS (SELECT 1 FROM listed h WHERE h.fpg = g.label AND h.fpc = c.label)
           OR (g.label <> 'Meals' AND (c.label <> p.label OR NOT EXISTS (
             SELECT 1 FROM listed h WHERE h.fpg = g.label AND h.fpc = p.label))) AS bad
  FROM g_best g JOIN c_best c USING (vec_id) JOIN p_best p USING (vec_id)
  JOIN b_best b USING (vec_id) JOIN fr_best fr USING (vec_id) JOIN pk_best pk USING (vec_id)
),
sub_long AS (
  SELECT vec_id, i, ({strings(scores.SUB_TYPE_LABELS)})[i] AS label,
         CASE WHEN i = {scores.SUB_TYPE_LABELS.index("None") + 1} THEN 0 ELSE s END AS s
  FROM (SELECT vec_id, unnest(st) AS s, generate_subscripts(st, 1) AS i FROM raw_scores)
),
sub_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn
                 FROM sub_long)
  WHERE rn <= 2 AND 1 / (1 + exp(-s)) > 0.5 AND label <> 'None'
),
place(label, col, n) AS (SELECT * FROM {_PLACES}),
sub_ordered AS (
  SELECT t.vec_id, t.label, row_number() OVER (PARTITION BY t.vec_id
           ORDER BY (t.label IN {_TAGS})::INTEGER, p.col, p.n, t.label) AS rank
  FROM sub_top t JOIN place p USING (label)
),
sub_types AS (
  SELECT v.vec_id, max(label) FILTER (rank = 1) AS st1, max(label) FILTER (rank = 2) AS st2,
         max(label) FILTER (rank = 3) AS st3
  FROM vec v LEFT JOIN sub_ordered USING (vec_id) GROUP BY v.vec_id
)"""
)


def _category_labels(alive: str) -> str:
    return ", ".join(
        f"CASE WHEN nonfood THEN 'Non-Food' WHEN {alive} THEN {c} END AS \"{name}\""
        for c, name in zip(("gl", "cl", "pl"), S.CATEGORY_LABELS)
    )


_ORACLE["softmax_argmax"] = f"{_DECODE} SELECT vec_id, label, round(p, 6) AS score FROM c_best"
_ORACLE["masked_argmax"] = f"""{_DECODE}
SELECT vec_id, CASE WHEN nonfood THEN 'Non-Food' ELSE gl END AS "Food Product Group",
       CASE WHEN NOT nonfood THEN bl END AS "Basic Type",
       CASE WHEN NOT nonfood THEN round(bp, 6) END AS score FROM joined"""
_ORACLE["consistency_assert"] = f"""{_DECODE}
SELECT vec_id, {_category_labels("NOT bad")} FROM joined"""
_ORACLE["nonfood_decode"] = f"""{_DECODE}
SELECT vec_id, {_category_labels("true")}, CASE WHEN NOT nonfood THEN bl END AS "Basic Type",
       CASE WHEN NOT nonfood THEN frl END AS "Frozen",
       CASE WHEN NOT nonfood THEN pkl END AS "Packaging" FROM joined"""
_ORACLE["top2_subtypes"] = f"""{_DECODE}
SELECT v.vec_id, coalesce(string_agg(label, '|' ORDER BY i), '') AS "Sub-Types"
FROM vec v LEFT JOIN sub_top USING (vec_id) GROUP BY v.vec_id"""
_ORACLE["order_subtypes"] = f"""{_DECODE}
SELECT vec_id, CASE WHEN NOT nonfood THEN st1 END AS "Sub-Type 1",
       CASE WHEN NOT nonfood THEN st2 END AS "Sub-Type 2",
       CASE WHEN NOT nonfood THEN st3 END AS "Sub-Type 3"
FROM joined JOIN sub_types USING (vec_id)"""
_ORACLE["combined_name"] = f"""{_DECODE}
SELECT vec_id, CASE WHEN nonfood THEN '' ELSE concat_ws(', ', nullif(bl, 'None'),
       nullif(frl, 'None'), nullif(pkl, 'None'), st1, st2, st3) END AS "Combined Name"
FROM joined JOIN sub_types USING (vec_id)"""

_ORACLE["masked_argmax_trained"] = f"""{_TRAINING},
type_index AS (SELECT label, index FROM label_index WHERE "column" = 'Basic Type'),
group_index AS (SELECT label, index FROM label_index WHERE "column" = 'Food Product Group'),
vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, g.label AS grp
  FROM embeddings JOIN group_index g ON g.index = vec_id % (SELECT count(*) FROM group_index)
),
seen_pairs AS (SELECT DISTINCT "Food Product Group" AS grp, "Basic Type" AS label FROM training),
scored AS (
  SELECT v.vec_id, v.grp, t.index, t.label,
    exp(e[t.index % 64 + 1]) / (1 + t.index % 7) * (s.label IS NOT NULL)::INTEGER AS score
  FROM vec v CROSS JOIN type_index t
  LEFT JOIN seen_pairs s ON s.grp = v.grp AND s.label = t.label
)
SELECT vec_id, grp AS "group", label, round(score, 6) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, index) = 1"""

_OUTPUT = {
    "Product Identifier": "vec_id::VARCHAR",
    "Product Type": "'P' || vec_id",
    "Basic Type": "bl",
    "Frozen": "nullif(frl, 'None')",
    "Packaging": "nullif(pkl, 'None')",
    "Sub-Type 1": "st1",
    "Sub-Type 2": "st2",
    "Sub-Type 3": "st3",
}


def _output_column(name: str) -> str:
    if name in S.PREDICTION_KEYS:
        return f'{_OUTPUT[name]} AS "{name}"'
    if name in _OUTPUT:
        return f'CASE WHEN NOT (nonfood OR bad) THEN {_OUTPUT[name]} END AS "{name}"'
    return f'NULL::VARCHAR AS "{name}"'


_ORACLE["inference_output"] = f"""{_DECODE}
SELECT {_category_labels("NOT bad")},
       {", ".join(_output_column(c) for c in S.PREDICTION_COLUMNS if c not in S.CATEGORY_LABELS)}
FROM joined JOIN sub_types USING (vec_id)"""

# --- evaluation ----------------------------------------------------------------------------------

_PAIRS = f"""{FULL_CTES},
every_name AS (
  SELECT nid, unnest(string_split(pn, ',')) AS raw,
         generate_subscripts(string_split(pn, ','), 1) AS pos
  FROM cleaned
),
every_token AS MATERIALIZED (
  SELECT nid, pos, coalesce(c.clean, e.word) AS tok
  FROM (SELECT nid, pos, trim(lower(raw), {WHITE}) AS word FROM every_name) e
  LEFT JOIN corrected c ON c.raw = e.word
),
first_token AS (SELECT nid, tok FROM every_token WHERE pos = 1),
both_sides AS (
  SELECT n.nid, n.fpg, n.fpc, n.pfpc, n.v0, c.fpg AS fpg_p, c.fpc AS fpc_p, c.pfpc AS pfpc_p,
         t.tok AS v0_p, [x for x in [v1, v2, v3] if x IS NOT NULL] AS truth
  FROM named n JOIN cleaned c USING (nid) LEFT JOIN first_token t USING (nid)
),
pairs AS (
  {" UNION ALL ".join(
      f"SELECT {text(h)} AS head, coalesce({c}, 'None') AS l, coalesce({c}_p, 'None') AS p "
      f"FROM both_sides"
      for h, c in zip([*S.CATEGORY_LABELS, "Basic Type"], ["fpg", "fpc", "pfpc", "v0"])
  )}
),
classes AS (
  SELECT head, k, sum(tp) AS tp, sum(su) AS su, sum(pr) AS pr FROM (
    SELECT head, l AS k, (l = p)::INTEGER AS tp, 1 AS su, 0 AS pr FROM pairs
    UNION ALL SELECT head, p, 0, 0, 1 FROM pairs
  ) GROUP BY head, k
),
heads AS (
  SELECT head, (SELECT avg((l = p)::INTEGER) FROM pairs q WHERE q.head = c.head) AS accuracy,
    sum(su * tp / pr) FILTER (pr > 0) / sum(su) FILTER (pr > 0) AS precision,
    sum(tp) / sum(su) AS recall,
    sum(su * 2 * tp / (su + pr)) / sum(su) AS f1
  FROM classes c GROUP BY head
)"""
_FOUR = ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
_ORACLE["head_metrics"] = f"{_PAIRS} SELECT head, {_FOUR} FROM heads"
_ORACLE["mean_metrics"] = f"""{_PAIRS}
SELECT round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1_score,
       round(max(accuracy) FILTER (head = 'Basic Type'), 6) AS basic_type_accuracy FROM heads"""
_ORACLE["multilabel_metrics"] = f"""{_PAIRS},
guesses AS (
  SELECT nid, list(DISTINCT tok) AS guess FROM every_token WHERE pos > 1 GROUP BY nid
),
sets AS (
  SELECT b.nid, list_sort(truth) AS truth, list_sort(coalesce(guess, []::VARCHAR[])) AS guess
  FROM both_sides b LEFT JOIN guesses USING (nid)
),
members AS (
  SELECT nid, unnest(truth) AS k, 1 AS t, 0 AS g FROM sets
  UNION ALL SELECT nid, unnest(guess), 0, 1 FROM sets
),
cells AS (SELECT nid, k, max(t) AS t, max(g) AS g FROM members GROUP BY nid, k),
sub AS (SELECT k, sum(t * g) AS tp, sum(t) AS su, sum(g) AS pr FROM cells GROUP BY k)
SELECT 'Sub-Types' AS head,
  (SELECT round(avg((truth = guess)::INTEGER), 6) FROM sets) AS accuracy,
  round(sum(su * tp / pr) FILTER (pr > 0) / sum(su) FILTER (pr > 0), 6) AS precision,
  round(sum(tp) / sum(su), 6) AS recall,
  round(sum(su * 2 * tp / (su + pr)) / sum(su), 6) AS f1
FROM sub"""

# --- classifier ----------------------------------------------------------------------------------

_TERMS = r"""lower(text) AS low FROM documents WHERE length(text) > 0 AND lang IS NOT NULL"""
_SPLIT = r"""unnest(string_split_regex(low, '[^\p{L}\p{N}%&''-]+'))"""
_ORACLE["text_features"] = f"""
WITH terms AS (
  SELECT doc_id, {_SPLIT} AS term FROM (SELECT doc_id, lower(text) AS low FROM documents)
),
counted AS (SELECT term, count(DISTINCT doc_id) AS texts FROM terms WHERE term <> '' GROUP BY term)
SELECT term, texts,
       round(ln(((SELECT count(text) FROM documents) + 1) / (texts + 1)), 6) AS idf
FROM counted"""
_ORACLE["bayes_terms"] = f"""
SELECT label, term, count(*) AS n FROM (
  SELECT lang AS label, {_SPLIT} AS term FROM (SELECT lang, {_TERMS}))
WHERE term <> '' GROUP BY ALL"""
_ORACLE["bayes_language"] = f"""
WITH texts AS (
  SELECT doc_id, lang AS label, md5(text)[1] IN ('0', '1', '2') AS held, {_TERMS}
),
words AS (
  SELECT * FROM (SELECT doc_id, label, held, {_SPLIT} AS term FROM texts) WHERE term <> ''
),
counts AS (SELECT label, term, count(*) AS n FROM words WHERE NOT held GROUP BY ALL),
sizes AS (SELECT label, sum(n) AS size FROM counts GROUP BY label),
shares AS (
  SELECT label, ln(count(*) / (SELECT count(*) FROM texts WHERE NOT held)) AS base
  FROM texts WHERE NOT held GROUP BY label
),
labels AS (
  SELECT label, base,
    coalesce(size, 0) + (SELECT count(DISTINCT term) FROM counts) AS denominator
  FROM shares LEFT JOIN sizes USING (label)
),
used AS (SELECT doc_id, term, count(*) AS n FROM words WHERE held GROUP BY ALL),
gains AS (
  SELECT u.doc_id, l.label, sum(u.n * ln((coalesce(c.n, 0) + 1) / l.denominator)) AS gain
  FROM used u CROSS JOIN labels l LEFT JOIN counts c ON c.term = u.term AND c.label = l.label
  GROUP BY ALL
),
scored AS (
  SELECT t.doc_id, l.label, l.base + coalesce(g.gain, 0) AS score
  FROM (SELECT doc_id FROM texts WHERE held) t CROSS JOIN labels l
  LEFT JOIN gains g ON g.doc_id = t.doc_id AND g.label = l.label
)
SELECT doc_id, label, round(score, 4) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1"""

_ORACLE["written_counts"] = f"""{_LONG}
SELECT replace("column", '/', '_') AS "column", nullif(value, '') AS value, count(*) AS count FROM long GROUP BY ALL"""

_MISSING = ", ".join("'" + text.replace("'", "''") + "'" for text in S.MISSING_TEXT)
_ORACLE["written_export"] = f"""SELECT COLUMNS(*)::VARCHAR FROM (
SELECT CASE WHEN COLUMNS(*)::VARCHAR NOT IN ({_MISSING}) THEN COLUMNS(*)::VARCHAR END
FROM ({_ORACLE["normalized_export"]}))"""

for _name in ("masked_argmax", "consistency_assert", "order_subtypes"):
    _ORACLE[f"{_name}_long"] = _ORACLE[_name]
_ORACLE["mask_bitmaps"] = _ORACLE["mask_vectors"]

ORACLES = dict(_ORACLE)
