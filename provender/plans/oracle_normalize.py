"""SQL that checks the name normalization on the same tables, written on its own.

It restates the rules as a recursive query over the tokens of each row and shares only the fixed
values (word lists and lookup tables) with the package.
"""

from __future__ import annotations

from provender import schema as S
from provender.plans import purchases as P
from provender.rules import fixed_values as V

TAG_FIELDS = [f"c{i}" for i in range(len(S.TAG_COLUMNS))]
SHAPE, PROCESSING, COOKED = "c1", "c4", "c5"


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]::VARCHAR[]"


def one_of(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def rows(values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(v) + ")" for v in values) + ")"


def named(fields, names) -> str:
    return ", ".join(f'{f} AS "{n}"' for f, n in zip(fields, names))


WHITE = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
    "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
    "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
    "||chr(8239)||chr(8287)||chr(12288)"
)

_MODS = strings(P.MODIFIERS)
_N = len(P.MODIFIERS)

PURCHASES = f"""
purchase_case(k, g, c, p, b) AS (SELECT * FROM {rows(
    [str(i), *map(text, case)] for i, case in enumerate(P.CASES)
)}),
purchase_keys AS (
  SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS pk, l_suppkey AS s, p_brand, s_name,
         (l_orderkey + l_linenumber) % 5 AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
),
purchase_names AS (
  SELECT k.*, g, c, p,
    CASE WHEN o % 83 = 0 THEN 'NULL' ELSE
      (CASE WHEN o % 31 = 0 THEN 'PREQUALIFIED: ' ELSE '' END)
      || b
      || (CASE WHEN n > 0 THEN ', ' || ({_MODS})[(s * 3 + o) % {_N} + 1] ELSE '' END)
      || (CASE WHEN n > 1 THEN ', ' || ({_MODS})[(s * 4 + o + 17) % {_N} + 1] ELSE '' END)
      || (CASE WHEN n > 2 THEN ', ' || ({_MODS})[(s * 5 + o + 34) % {_N} + 1] ELSE '' END)
      || (CASE WHEN n > 3 THEN ', ' || ({_MODS})[(s * 6 + o + 51) % {_N} + 1] ELSE '' END)
      || (CASE WHEN o % 53 = 0 THEN ', ' ELSE '' END)
    END AS raw_name
  FROM purchase_keys k JOIN purchase_case x ON x.k = (pk + l) % {len(P.CASES)}
),
raw_purchases AS (
  SELECT
    lpad(o::VARCHAR, 12, '0') || '-' || lpad(l::VARCHAR, 12, '0') || '-'
      || lpad(pk::VARCHAR, 12, '0') || '-' || lpad(s::VARCHAR, 12, '0') AS row_id,
    concat_ws('-', o, l, pk, s) AS uid,
    s_name AS origin,
    CASE WHEN o % 97 = 0 THEN NULL
         WHEN o % 89 = 0 THEN 'ab'
         WHEN o % 101 = 0 THEN {text(P.EXCLUDED_ROW)}
         WHEN o % 61 = 0 THEN ({strings(P.OVERRIDE_KEYS)})[s % {len(P.OVERRIDE_KEYS)} + 1]
         ELSE (CASE WHEN o % 7 = 0 THEN chr(9) || chr(160) || ' ' ELSE '' END)
              || upper(raw_name)
              || (CASE WHEN s % 3 = 0 THEN ' ALL MEAT ' ELSE ' ' END)
              || p_brand
              || (CASE WHEN o % 11 = 0 THEN ' ' || chr(160) ELSE '' END)
    END AS pt0,
    CASE WHEN o % 43 = 0 THEN 'REVISED ' || upper(raw_name) END AS npt,
    raw_name AS pn0, g AS fpg0, c AS fpc0, p AS pfpc0
  FROM purchase_names
),
loaded AS (
  SELECT row_id, uid, origin, coalesce(npt, pt0) AS pt0,
         CASE WHEN pn0 IN {one_of(S.MISSING_TEXT)} THEN NULL ELSE pn0 END AS pn0,
         fpg0, fpc0, pfpc0
  FROM raw_purchases
),
cleaned AS MATERIALIZED (
  SELECT row_number() OVER () AS nid, row_id, uid, origin, pt,
    CASE WHEN fpc = 'Non-Food' THEN NULL
         WHEN starts_with(pn0, 'PREQUALIFIED: ') THEN substr(pn0, 15) ELSE pn0 END AS pn,
    fpg, fpc,
    CASE WHEN fpc = 'Non-Food' THEN 'Non-Food'
         WHEN pfpc0 = 'Whole/Minimally Processed' THEN fpc
         WHEN pfpc0 = 'Roots & Tuber' THEN 'Roots & Tubers'
         ELSE pfpc0 END AS pfpc
  FROM (SELECT *, trim(pt0, {WHITE}) AS pt, fpg0 AS fpg, fpc0 AS fpc FROM loaded)
  WHERE ((length(pt) >= 3 AND length(pn0) >= 3) OR fpc = 'Non-Food')
    AND pt IS DISTINCT FROM {text(P.EXCLUDED_ROW)}
)"""

CORRECTIONS = f"""
correction(raw, clean) AS (SELECT * FROM {rows(
    [text(a), text(b)] for a, b in V.CORRECTIONS.items()
)}),
correction_chain(raw, clean) AS (
  SELECT raw, clean FROM correction
  UNION ALL
  SELECT c.raw, d.clean FROM correction_chain c JOIN correction d ON c.clean = d.raw
),
corrected AS (
  SELECT raw, clean FROM correction_chain
  WHERE clean NOT IN (SELECT raw FROM correction)
)"""

_HIERARCHY = []
for _group, _members in V.HIERARCHY.items():
    for _member in _members:
        _HIERARCHY.append((len(_HIERARCHY), _group, _member))

HIERARCHY = f"""
listed(i, fpg, fpc) AS (SELECT * FROM {rows(
    [str(i), text(g), text(c)] for i, g, c in _HIERARCHY
)}),
hierarchy AS (SELECT fpc, min(i) AS i, max_by(fpg, i) AS fpg FROM listed GROUP BY fpc)"""

_SCOPES = [
    [text(scope), text(column), text(tag)]
    for scope, columns in V.TAG_SCOPES.items()
    for column, tags in columns.items()
    for tag in tags
]

TAG_GATE = f"""
scope(scope, col, tag) AS (SELECT * FROM {rows(_SCOPES)}),
own_tags AS (
  SELECT DISTINCT h.i, h.fpc, h.fpg, s.col, s.tag,
         (h.fpg IN ('Meat', 'Meals') AND s.col = 'Processing') AS private
  FROM hierarchy h JOIN scope s ON s.scope IN (h.fpg, h.fpc)
),
first_seen AS (
  SELECT col, tag, min(i) AS since FROM (
    SELECT col, tag, -1 AS i FROM scope WHERE scope = 'All'
    UNION ALL SELECT col, tag, i FROM own_tags WHERE NOT private
  ) GROUP BY ALL
),
gate AS (
  SELECT h.fpc, f.tag, f.col FROM hierarchy h JOIN first_seen f ON f.since <= h.i
  WHERE NOT (h.fpg IN ('Meat', 'Meals') AND f.tag = 'whipped')
  UNION SELECT fpc, tag, col FROM own_tags
),
isolated_gate AS (
  SELECT h.fpc, s.tag, s.col FROM hierarchy h JOIN scope s ON s.scope = 'All'
  WHERE NOT (h.fpg IN ('Meat', 'Meals') AND s.tag = 'whipped')
  UNION SELECT fpc, tag, col FROM own_tags
)"""


def _mapped(table: dict) -> str:
    """Lookup table rows: key, basic type, sub-types, 13 columns, group, category, primary."""
    return rows(
        [
            text(key),
            text(row.get("Basic Type")),
            strings(row.get("Sub-Types", [])),
            *[text(row.get(c)) for c in [*S.TAG_COLUMNS, *S.CATEGORY_LABELS]],
        ]
        for key, row in table.items()
    )


def _packed(table: dict) -> str:
    """Lookup table rows: key, sub-types, and all other values as one list."""
    columns = ["Basic Type", *S.TAG_COLUMNS, *S.CATEGORY_LABELS]
    return rows(
        [text(key), strings(row.get("Sub-Types", [])), strings(row.get(c) for c in columns)]
        for key, row in table.items()
    )


_KEYED = "key, bt, st, " + ", ".join(TAG_FIELDS) + ", fpg, fpc, pfpc"

TOKENS = f"""
type_map({_KEYED}) AS (SELECT * FROM {_mapped(V.TYPE_MAP)}),
override(key, st, vals) AS (SELECT * FROM {_packed(V.PRODUCT_TYPE_OVERRIDES)}),
folded_rows AS MATERIALIZED (
  SELECT nid, pt, pn, fpg, fpc, pfpc, CASE WHEN fpc = 'Meals' THEN pfpc ELSE fpc END AS tagcat
  FROM cleaned
  WHERE fpc IS DISTINCT FROM 'Non-Food' AND pt NOT IN (SELECT key FROM override)
),
split_names AS (
  SELECT nid, fpg, fpc, tagcat, unnest(string_split(pn, ',')) AS raw,
         generate_subscripts(string_split(pn, ','), 1) AS pos
  FROM folded_rows
),
token AS MATERIALIZED (
  SELECT nid, pos, fpg, fpc, tagcat, coalesce(c.clean, t.word) AS tok
  FROM (SELECT *, trim(lower(raw), {WHITE}) AS word FROM split_names) t
  LEFT JOIN corrected c ON c.raw = t.word
)"""

_L = V.VOCABULARIES
_ALL_FLAVORS = list(dict.fromkeys(V.FLAVORS + _L["fruits"]))


def _token_case(result: str) -> str:
    """First token rule that holds; ``result`` picks the new token or the effect."""
    arms = [
        ("(bt='snack' AND tok='bar') OR (bt='herb' AND tok='watercress')", "NULL", "retype"),
        (
            "(tok='blue' AND bt='cheese') OR (tok='instant' AND fpg='Beverages') OR "
            "(tok='black' AND bt IN ('tea','drink')) OR (tok='gluten free' AND st[1]='parfait')",
            "tok",
            "",
        ),
        (
            "(fpg='Milk & Dairy' AND tok IN ('in brine','nectar','honey')) "
            "OR (fpg='Meat' AND tok IN ('ketchup','italian')) "
            "OR (fpg='Produce' AND tok IN ('whole','peeled','kosher','gluten free')) "
            "OR (fpg='Seafood' AND tok IN ('seasoned','stuffed','lime')) "
            "OR (fpg='Condiments & Snacks' AND tok IN ('shredded','non-dairy')) "
            "OR (fpc='Cheese' AND tok IN ('in water','ball','low moisture','whole milk','logs',"
            "'unsalted','in oil')) "
            "OR (bt='plant milk' AND tok IN ('nonfat','low fat')) "
            "OR (bt='bean' AND tok='turtle') OR (bt='supplement' AND tok='liquid') "
            "OR (bt='bar' AND tok IN ('cereal','cocoa','seed')) "
            "OR (bt='ice cream' AND tok IN ('crunch','taco','chocolate covered','cookie')) "
            "OR (bt='salsa' AND tok IN ('thick','chunky','mild')) "
            "OR (fpc='Grain Products' AND bt<>'cereal' AND tok='wheat') "
            "OR (bt='condiment' AND tok IN ('thick','thin','sweet')) "
            "OR (bt='cookie' AND tok='sugar') "
            "OR (bt='dessert' AND tok IN ('crumb','graham cracker')) "
            "OR (bt='mix' AND tok='custard')",
            "NULL",
            "",
        ),
        (
            f"((fpg='Beverages' OR fpc='Cheese' OR bt IN {one_of(_L['flavored_types'])}) "
            f"AND tok IN {one_of(_ALL_FLAVORS)}) "
            f"OR ((bt='bar' OR fpg='Seafood') AND tok IN {one_of(V.FLAVORS)})",
            "'flavored'",
            "",
        ),
        (
            f"bt IN {one_of(_L['flavor_skipping_types'])} AND tok IN {one_of(_ALL_FLAVORS)}",
            "NULL",
            "",
        ),
        (
            f"bt IN {one_of(_L['shape_skipping_types'])} AND tok IN {one_of(_L['shape_extras'])}",
            "NULL",
            "",
        ),
        ("tok='grated' AND fpc IS DISTINCT FROM 'Cheese'", "'cut'", ""),
        ("tok='mix' AND fpg='Beverages'", "'concentrate'", ""),
        ("tok='taco meat'", "NULL", "taco"),
        ("tok='pulled' AND fpg IN ('Meat','Meals')", "NULL", "cutcook"),
        ("tok='pulled'", "NULL", ""),
        ("tok='stick' AND fpg IN ('Produce','Seafood')", "'cut'", ""),
        ("tok='stick' AND fpc IN ('Cheese','Meat')", "'ss'", ""),
        ("tok='shredded' AND fpg='Meat'", "NULL", "cutcook"),
        ("tok='shredded'", "'cut'", ""),
        ("tok='powder' AND fpg='Beverages'", "'concentrate'", ""),
        ("tok='popper'", "NULL", "popper"),
        ("tok='popcorn' AND fpc IN ('Seafood','Chicken')", "NULL", "popcorn"),
        (f"bt='snack' AND tok IN {one_of(_L['nuts'])}", "'nut'", ""),
        (f"(fpg='Meals' OR bt='snack') AND tok IN {one_of(_L['cheeses'])}", "'cheese'", ""),
        ("st[1]='pickle' AND tok='chip'", "'cut'", ""),
        ("tok='base' AND fpg='Beverages'", "'mix'", ""),
        ("tok='grated' AND fpg IS DISTINCT FROM 'Milk & Dairy'", "'cut'", ""),
        ("tok='string' AND bt='cheese'", "'ss'", ""),
        (f"tok IN {one_of(V.SKIPPED)}", "NULL", ""),
    ]
    picked = [(c, t if result == "token" else text(e)) for c, t, e in arms]
    last = "tok" if result == "token" else "''"
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in picked) + f" ELSE {last} END"


def _in_map(table: dict) -> str:
    return one_of(table)


def _from_map(table: dict) -> str:
    return (
        "CASE t2 "
        + " ".join(f"WHEN {text(k)} THEN {strings(v)}" for k, v in table.items())
        + " END"
    )


_SUBTYPE_ADD = f"""CASE
  WHEN t2 IN {_in_map(V.SUBTYPE_VALUES)} THEN {_from_map(V.SUBTYPE_VALUES)}
  WHEN t2='applesauce' AND bt IS DISTINCT FROM 'baby food' THEN []::VARCHAR[]
  WHEN t2='fruit and vegetable' AND fpg='Beverages' THEN ['fruit punch']
  WHEN t2='fruit medley' AND bt='juice' THEN ['blend']
  WHEN t2='funnel cake' AND bt='dessert' THEN ['cake']
  WHEN t2 IN ('variety','mix') AND bt='vegetable' THEN ['blend']
  WHEN t2='peanut butter and jelly' THEN (CASE WHEN fpg='Meals' THEN [t2] ELSE []::VARCHAR[] END)
  WHEN t2='fajita' THEN (CASE WHEN bt='vegetable' THEN ['blend'] ELSE ['seasoned'] END)
  WHEN t2='vanilla chocolate almond' THEN ['nut']
  WHEN t2 IN {_in_map(V.SUBTYPE_EXPANSIONS)} THEN {_from_map(V.SUBTYPE_EXPANSIONS)}
  WHEN t2 IN {one_of(_L["fruit_snacks"])} THEN []::VARCHAR[]
  WHEN t2 IN {one_of(_L["chocolate_kinds"])} THEN ['chocolate']
  WHEN t2 IN {one_of(_L["cocoa_kinds"])} THEN ['cocoa']
  WHEN t2 IN {one_of(_L["wheat_cereals"])} THEN ['wheat']
  WHEN t2 IN {one_of(_L["corn_cereals"])} THEN ['corn']
  WHEN t2 IN {one_of(_L["oat_cereals"])} THEN ['oat']
  WHEN t2 IN {_in_map(V.CEREAL_GRAINS)} THEN {_from_map(V.CEREAL_GRAINS)}
  ELSE [t2] END"""


def _append(base: str, extra: str) -> str:
    """Ordered-set union: what ``extra`` has and ``base`` lacks goes to the end, once."""
    return (
        f"list_concat({base}, list_filter({extra}, lambda x, i: NOT list_contains({base}, x) "
        f"AND list_position({extra}, x) = i))"
    )


def _overwritten(field: str) -> str:
    arms = {
        SHAPE: "WHEN effect='taco' THEN 'crumble' WHEN effect IN ('cutcook','popcorn') THEN 'cut'",
        PROCESSING: "WHEN effect='taco' THEN 'seasoned' "
        "WHEN effect IN ('popper','popcorn') THEN 'breaded'",
        COOKED: "WHEN effect='cutcook' THEN 'cooked'",
    }.get(field, "")
    number = TAG_FIELDS.index(field)
    return f"CASE {arms} WHEN placed AND col = {text(S.TAG_COLUMNS[number])} THEN t2 ELSE {field} END"


_HELD = (
    "CASE col "
    + " ".join(f"WHEN {text(c)} THEN {f}" for c, f in zip(S.TAG_COLUMNS, TAG_FIELDS))
    + " END"
)
_STATE = "nid, pos, bt, st, " + ", ".join(TAG_FIELDS)

FOLD = f"""
fold({_STATE}) AS (
  SELECT t.nid, 1, coalesce(m.bt, t.tok), coalesce(m.st, []::VARCHAR[]),
         {", ".join(f"m.{f}::VARCHAR" for f in TAG_FIELDS)}
  FROM token t LEFT JOIN type_map m ON m.key = t.tok WHERE t.pos = 1
  UNION ALL
  SELECT nid, pos,
    CASE WHEN effect='retype' THEN tok
         WHEN to_subtypes AND t2 IN {one_of(_L["fruit_snacks"])}
              AND t2 NOT IN {_in_map(V.SUBTYPE_VALUES)} THEN 'fruit snack' ELSE bt END,
    CASE WHEN effect='popper' THEN {_append("st", "['cheese']")}
         WHEN NOT to_subtypes THEN st
         WHEN t2 IN {one_of(V.FRONT_EXPANSIONS)} THEN {_append("more", "st")}
         ELSE {_append("st", "more")} END,
    {", ".join(_overwritten(f) for f in TAG_FIELDS)}
  FROM (
    SELECT *, (t2 IS NOT NULL AND NOT placed) AS to_subtypes, {_SUBTYPE_ADD} AS more
    FROM (
      SELECT *, (col IS NOT NULL AND coalesce({_HELD} = t2, true)) AS placed
      FROM (
        SELECT a.*, g.col
        FROM (
          SELECT f.nid, t.pos, f.bt, f.st, {", ".join("f." + c for c in TAG_FIELDS)},
                 t.tok, t.fpg, t.fpc, t.tagcat,
                 {_token_case("token")} AS t2, {_token_case("effect")} AS effect
          FROM fold f JOIN token t ON t.nid = f.nid AND t.pos = f.pos + 1
        ) a
        LEFT JOIN gate g ON g.fpc = a.tagcat AND g.tag = a.t2
          AND NOT (a.t2 = 'pepperoni' AND coalesce(a.fpg = 'Meals', false))
      )
    )
  )
),
last_state AS (
  SELECT f.* FROM fold f
  JOIN (SELECT nid, max(pos) AS pos FROM token GROUP BY nid) e USING (nid, pos)
)"""


def _members(kind: str) -> str:
    earlier = {
        "fruits": [],
        "cheeses": _L["fruits"],
        "melons": _L["fruits"] + _L["cheeses"] + _L["vegetables"],
    }[kind]
    words = [w for w in _L[kind] if w not in set(earlier)]
    return f"list_filter(st1, lambda x: list_contains({strings(words)}, x))"


_VALUES = ["bt1", "x1", "x2", "x3", *TAG_FIELDS]


def _unique(i: int) -> str:
    if i == 0:
        return _VALUES[0]
    same = " OR ".join(f"coalesce({_VALUES[i]} = {v}, false)" for v in _VALUES[:i])
    return f"CASE WHEN {same} THEN NULL ELSE {_VALUES[i]} END"


_V = [f"v{i}" for i in range(len(_VALUES))]
_SLOTS = ", ".join(_V)

NORMALIZED = f"""
repaired AS (
  SELECT l.*, r.pt, r.pn, r.pfpc AS pfpc0,
    CASE WHEN bt='chili' AND fpg='Condiments & Snacks' THEN 'spice'
         WHEN bt='chili' AND fpg='Produce' THEN 'pepper'
         WHEN bt='bologna' AND contains(lower(pt), 'all') THEN 'beef'
         WHEN bt='chickpea' AND contains(lower(pn), 'roasted') THEN 'snack'
         WHEN bt='beverage' AND st[1]='energy drink' THEN 'energy drink'
         ELSE bt END AS bt1,
    CASE WHEN bt='chili' AND fpg IN ('Condiments & Snacks','Produce')
           THEN {_append("['chili']", "st")}
         WHEN bt='bologna' AND contains(lower(pt), 'all') THEN ['pork','bologna']
         WHEN bt='chickpea' AND contains(lower(pn), 'roasted') THEN {_append("['chickpea']", "st")}
         WHEN bt='beverage' AND st[1]='energy drink' THEN st[2:]
         ELSE st END AS st1,
    CASE WHEN bt='spice' AND fpg IS DISTINCT FROM 'Condiments & Snacks'
           THEN 'Condiments & Snacks' ELSE fpg END AS fpg1,
    CASE WHEN bt='spice' AND fpg IS DISTINCT FROM 'Condiments & Snacks'
           THEN 'Condiments & Snacks'
         WHEN bt='bologna' AND contains(lower(pt), 'all') THEN 'Beef' ELSE fpc END AS fpc1,
    CASE WHEN bt='bologna' AND contains(lower(pt), 'all') THEN 'Beef' ELSE pfpc END AS pfpc1
  FROM last_state l JOIN folded_rows r USING (nid)
),
kinds AS (
  SELECT *, {_members("fruits")} AS fr, {_members("cheeses")} AS ch, {_members("melons")} AS me
  FROM repaired
),
swapped AS (
  SELECT *,
    list_concat(
      CASE WHEN len(fr) > 1 THEN [CASE WHEN fpc1='Fruit' THEN 'blend' ELSE 'fruit' END]
           ELSE []::VARCHAR[] END,
      CASE WHEN len(ch) > 1 THEN ['blend'] ELSE []::VARCHAR[] END,
      CASE WHEN len(me) > 1 THEN ['variety'] ELSE []::VARCHAR[] END) AS gained,
    list_concat(CASE WHEN len(fr) > 1 THEN fr ELSE []::VARCHAR[] END,
                CASE WHEN len(ch) > 1 THEN ch ELSE []::VARCHAR[] END,
                CASE WHEN len(me) > 1 THEN me ELSE []::VARCHAR[] END) AS lost
  FROM kinds
),
joined_st AS (SELECT *, {_append("st1", "gained")} AS st2 FROM swapped),
kept_st AS (
  SELECT *, list_filter(st2, lambda x: NOT list_contains(lost, x)) AS st3 FROM joined_st
),
final_st AS (
  SELECT *, list_concat(
      CASE WHEN list_contains(st3, 'variety') THEN ['variety'] ELSE []::VARCHAR[] END,
      CASE WHEN list_contains(st3, 'blend') THEN ['blend'] ELSE []::VARCHAR[] END,
      list_filter(st3, lambda x: x NOT IN ('variety', 'blend'))) AS stf
  FROM kept_st
),
states AS (
  SELECT nid, 'fold' AS route, bt1, stf, fpg1, fpc1, pfpc1, {", ".join(TAG_FIELDS)} FROM final_st
  UNION ALL
  SELECT c.nid, 'override', o.vals[1], o.st, coalesce(o.vals[15], c.fpg),
         coalesce(o.vals[16], c.fpc), coalesce(o.vals[17], c.pfpc),
         {", ".join(f"o.vals[{i + 2}]" for i in range(len(TAG_FIELDS)))}
  FROM cleaned c JOIN override o ON o.key = c.pt WHERE c.fpc IS DISTINCT FROM 'Non-Food'
  UNION ALL
  SELECT nid, 'non-food', NULL, []::VARCHAR[], fpg, fpc, pfpc, {", ".join("NULL" for _ in TAG_FIELDS)}
  FROM cleaned WHERE fpc = 'Non-Food'
),
packed_states AS (
  SELECT nid, stf, [route, fpg1, fpc1, pfpc1, bt1, stf[1], stf[2], stf[3],
                    {", ".join(TAG_FIELDS)}] AS vals FROM states
),
packed_rows AS (SELECT nid, [row_id, uid, origin, pt, pn] AS ids FROM cleaned),
slots AS (
  SELECT nid, stf, ids[1] AS row_id, ids[2] AS uid, ids[3] AS origin, ids[4] AS pt, ids[5] AS pn,
         vals[1] AS route, vals[2] AS fpg, vals[3] AS fpc, vals[4] AS pfpc,
         {", ".join(f"vals[{i + 5}] AS {v}" for i, v in enumerate(_VALUES))}
  FROM packed_states JOIN packed_rows USING (nid)
),
normalized AS MATERIALIZED (
  SELECT nid, row_id, uid, origin, pt, pn, route, fpg, fpc, pfpc, stf,
         CASE WHEN route = 'non-food' THEN NULL ELSE stf[4:] END AS misc,
         {", ".join(
             f"CASE WHEN route = 'fold' THEN {_unique(i)} ELSE {_VALUES[i]} END AS v{i}"
             for i in range(len(_VALUES))
         )}
  FROM slots
),
named AS (SELECT *, concat_ws(', ', {_SLOTS}) AS name FROM normalized)"""

CLEAN_CTES = f"WITH RECURSIVE {PURCHASES}"
TOKEN_CTES = f"WITH RECURSIVE {PURCHASES},{CORRECTIONS},{TOKENS}"
GATE_CTES = f"WITH RECURSIVE {PURCHASES},{CORRECTIONS},{TOKENS},{HIERARCHY},{TAG_GATE}"
FULL_CTES = f"{GATE_CTES},{FOLD},{NORMALIZED}"

# Select lists under the exported column names.
NORMALIZED_FIELDS = named(_V, S.NORMALIZED_COLUMNS)
EXPORT_FIELDS = named(["pt", "fpg", "fpc", "pfpc", "pn", *_V], S.EXPORT_COLUMNS)
