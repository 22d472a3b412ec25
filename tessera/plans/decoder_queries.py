"""Every card decoder over decks written from the customer table: one query a family of kinds, in long form.

A deck holds a section for each customer; the numbers in its cards follow from the customer's
key, so the SQL says what each field must hold without reading any card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import views
from tessera.plans.base import ORACLE, QUERIES, table
from tessera.sources.cards import KINDS, MATERIAL_TYPES, fields
from tessera.sources.deck import Deck, cell

#: Family -> (kind, keyword line, type that it must give or None).
FAMILIES: dict[str, list[tuple[str, str, str | None]]] = {
    "deck_nodes_of_cards": [("node", "*NODE", None)],
    "deck_elements": [("element_shell", "*ELEMENT_SHELL_THICKNESS", None), ("element_solid", "*element_solid", None), ("element_beam", "*ELEMENT_BEAM", None)],
    "deck_parts_of_cards": [("part", "*PART", None)],
    "deck_sections": [("section_shell", "*SECTION_SHELL_TITLE", None), ("section_solid", "*SECTION_SOLID", None), ("section_beam", "*SECTION_BEAM_TITLE", None)],
    "deck_contacts": [("contact", "*CONTACT_AUTOMATIC_NODES_TO_SURFACE_ID", "AUTOMATIC_NODES_TO_SURFACE"), ("contact", "*CONTACT_TIED_SURFACE_TO_SURFACE", "TIED_SURFACE_TO_SURFACE"), ("contact", "*CONTACT_ERODING_SINGLE_SURFACE_TITLE", "OTHER")],
    "deck_boundaries": [("boundary_spc", "*BOUNDARY_SPC_SET", "SET"), ("boundary_spc", "*BOUNDARY_SPC_NODE", "NODE"), ("boundary_motion", "*BOUNDARY_PRESCRIBED_MOTION_RIGID", "RIGID"), ("boundary_motion", "*BOUNDARY_PRESCRIBED_MOTION_SET", "SET")],
    "deck_loads": [("load_node", "*LOAD_NODE_SET", "SET"), ("load_node", "*LOAD_NODE_POINT", "POINT"), ("load_segment", "*LOAD_SEGMENT", None), ("load_body", "*LOAD_BODY_Y", "Y"), ("load_body", "*LOAD_BODY_PARTS", "OTHER")],
    "deck_controls": [(f"control_{x}", f"*CONTROL_{x.upper()}", None) for x in ("termination", "timestep", "energy", "output", "shell", "contact", "hourglass", "bulk_viscosity")],
    "deck_databases": [("database_binary", "*DATABASE_BINARY_D3THDT", "D3THDT"), ("database_binary", "*DATABASE_BINARY_D3PLOT", "D3PLOT"), ("database_ascii", "*DATABASE_GLSTAT", "GLSTAT"), ("database_ascii", "*DATABASE_RCFORC", "RCFORC"), ("database_cross_section", "*DATABASE_CROSS_SECTION_SET", None)],
    "deck_initials": [("initial_velocity_generation", "*INITIAL_VELOCITY_GENERATION", None), ("initial_velocity", "*INITIAL_VELOCITY_NODE", "NODE"), ("initial_velocity", "*INITIAL_VELOCITY", "PLAIN")],
    "deck_constraints": [("nodal_rigid_body", "*CONSTRAINED_NODAL_RIGID_BODY_INERTIA", "INERTIA"), ("extra_nodes_set", "*CONSTRAINED_EXTRA_NODES_SET", None), ("joint", "*CONSTRAINED_JOINT_CYLINDRICAL", "CYLINDRICAL"), ("joint", "*CONSTRAINED_JOINT_GEARS", "OTHER"), ("spotweld", "*CONSTRAINED_SPOTWELD", None)],
}
#: Kinds that list ids or segments: (kind, keyword line, type).
LISTS = [
    ("set_node", "*SET_NODE_LIST_TITLE", None), ("set_part", "*SET_PART_LIST", None), ("set_shell", "*SET_SHELL_LIST_TITLE", None), ("set_solid", "*SET_SOLID", None),
    ("extra_nodes", "*CONSTRAINED_EXTRA_NODES_NODE", None), ("database_history", "*DATABASE_HISTORY_SOLID", "SOLID"), ("database_history", "*DATABASE_HISTORY_NODE", "NODE"),
]
#: Lines that one customer's section may take.
ROOM = 32


def _number(place: int, letter: str) -> str:
    """SQL of the value in the field at that place."""
    return f"((c_custkey * {place + 3} + {place}) % 997 + 1)" if letter == "i" else f"((c_custkey * {place + 5} + {place}) % 991) * 0.25"


def _values(kind: str) -> list[tuple[int, str, str, int, int]]:
    """(card, name, letter, start, width) of all fields of a kind's cards."""
    return [(i, *field) for i, card in enumerate(KINDS[kind].cards) for field in fields(card)]


def _card(kind: str, card: int) -> Column:
    """The line of a card, its fields right-aligned."""
    own = [(place, letter, width) for place, (i, _, letter, _, width) in enumerate(_values(kind)) if i == card]
    return F.concat(*(F.lpad(F.expr(_number(place, letter)).cast("string"), width, " ") for place, letter, width in own))


def written(spark: SparkSession, sf_dir: str, bodies: list[tuple[str, list[Column]]]) -> DataFrame:
    """A deck of one file for each (name, lines), in which every customer has a section of these lines."""
    rows = [F.struct(F.lit(name).alias("file"), F.lit(i).alias("i"), line.alias("line")) for name, lines in bodies for i, line in enumerate(lines)]
    own, found = table(spark, sf_dir, "customer").select("c_custkey"), None
    for at in range(0, len(rows), 16):  # more are too long for compiled code
        one = own.select("c_custkey", F.explode(F.array(*rows[at : at + 16])).alias("r")).select("r.file", (F.col("c_custkey").cast("bigint") * ROOM + F.col("r.i")).alias("line_no"), "r.line")
        found = one if found is None else found.unionByName(one)
    return found


def _title(kind: str, keyword: str) -> list[Column]:
    titled = KINDS[kind].titled == "always" or (KINDS[kind].titled and keyword.endswith(("_TITLE", "_ID")))
    return [F.concat(F.lit(" Title "), F.col("c_custkey").cast("string"))] if titled else []


def _fields(numbers: dict[str, Column], texts: dict[str, Column]) -> Column:
    """An array of (field, number, text)."""
    rows = [F.struct(F.lit(k).alias("field"), v.cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for k, v in numbers.items()]
    rows += [F.struct(F.lit(k).alias("field"), F.lit(None).cast("double").alias("number"), v.cast("string").alias("text")) for k, v in texts.items()]
    return F.array(*rows)


def _long(found: DataFrame, rows: Column) -> DataFrame:
    """kind, id, field, number and text, a row for each field."""
    return found.select(F.col("file").alias("kind"), F.floor(F.col("line_no") / ROOM).alias("id"), F.explode(rows).alias("r")).select("kind", "id", "r.field", "r.number", "r.text")


def _decoded(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = FAMILIES[name]
        deck = Deck(written(spark, sf_dir, [(f"{kind} {keyword}", [F.lit(keyword), *_title(kind, keyword), F.lit("$ comment"), *(_card(kind, i) for i in range(len(KINDS[kind].cards)))]) for kind, keyword, _ in own])).stored()
        found = None
        for kind, keyword, type_ in own:
            rows = deck[kind].where(F.col("file") == f"{kind} {keyword}")
            texts = ({"type": F.col("type")} if type_ else {}) | ({"title": F.col("title")} if _title(kind, keyword) else {})
            if kind.startswith("element_"):
                numbers = {"eid": F.col("eid"), "pid": F.col("pid"), "node_count": F.col("node_count")}
                texts = {"type": F.col("type"), "nodes": F.array_join("nodes", ",")}
            else:
                numbers = {field: F.col(field) for _, field, *_ in _values(kind)}
                if kind == "control_bulk_viscosity":
                    numbers["type"] = F.col("type")
            one = _long(rows, _fields(numbers, texts))
            found = one if found is None else found.unionByName(one)
        return found

    return run


def _decoded_sql(name: str) -> str:
    rows = []
    for kind, keyword, type_ in FAMILIES[name]:
        head = f"SELECT '{kind} {keyword}' AS kind, c_custkey::BIGINT AS id"
        values = _values(kind)
        if kind.startswith("element_"):
            rows += [f"{head}, '{f}' AS field, {_number(i, 'i')}::DOUBLE AS number, NULL::VARCHAR AS text FROM customer" for i, f in enumerate(("eid", "pid"))]
            rows.append(f"{head}, 'node_count', 8::DOUBLE, NULL FROM customer")
            rows.append(f"{head}, 'type', NULL, '{kind.removeprefix('element_')}' FROM customer")
            rows.append(f"{head}, 'nodes', NULL, concat_ws(',', {', '.join(_number(i, 'i') for i in range(2, 10))}) FROM customer")
            continue
        rows += [f"{head}, '{field}' AS field, {_number(place, letter)}::DOUBLE AS number, NULL::VARCHAR AS text FROM customer" for place, (_, field, letter, *_) in enumerate(values)]
        if type_:
            rows.append(f"{head}, 'type', NULL, '{type_}' FROM customer")
        if KINDS[kind].titled == "always" or (KINDS[kind].titled and keyword.endswith(("_TITLE", "_ID"))):
            rows.append(f"{head}, 'title', NULL, 'Title ' || c_custkey FROM customer")
    return " UNION ALL ".join(rows)


for _name in FAMILIES:
    _run = _decoded(_name)
    _run.__name__ = _name
    QUERIES[_name], ORACLE[_name] = _run, _decoded_sql(_name)


def deck_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of every kind, extra nodes and history requests: eleven ids over two lines, zeros and blanks left out."""
    ids = lambda low, high: F.concat(*(F.lpad(F.expr(f"c_custkey * 20 + {i}").cast("string") if i % 5 else F.lit("0"), 10, " ") for i in range(low, high)))
    head = {True: [F.lpad(F.col("c_custkey").cast("string"), 10, " ")], False: []}
    deck = Deck(written(spark, sf_dir, [(f"{kind} {keyword}", [F.lit(keyword), *_title(kind, keyword), *head[bool(KINDS[kind].cards[0])], ids(0, 8), ids(8, 14)]) for kind, keyword, _ in LISTS])).stored()
    found = None
    for kind, keyword, type_ in LISTS:
        rows = deck[kind].where(F.col("file") == f"{kind} {keyword}")
        texts = {"ids": F.array_join("ids", ",")} | ({"type": F.col("type")} if type_ else {}) | ({"title": F.col("title")} if _title(kind, keyword) else {})
        numbers = {"n": F.size("ids")} | ({fields(KINDS[kind].cards[0])[0][0]: F.col(fields(KINDS[kind].cards[0])[0][0])} if KINDS[kind].cards[0] else {})
        one = _long(rows, _fields(numbers, texts))
        found = one if found is None else found.unionByName(one)
    return found


def _id_lists_sql() -> str:
    rows = []
    for kind, keyword, type_ in LISTS:
        head = f"SELECT '{kind} {keyword}' AS kind, c_custkey::BIGINT AS id"
        only = " WHERE c_custkey > 0" if kind.startswith("set_") else ""  # a set needs an id
        rows.append(f"{head}, 'n' AS field, 11::DOUBLE AS number, NULL::VARCHAR AS text FROM customer{only}")
        rows.append(f"{head}, 'ids', NULL, concat_ws(',', {', '.join(f'c_custkey * 20 + {i}' for i in range(14) if i % 5)}) FROM customer{only}")
        if KINDS[kind].cards[0]:
            rows.append(f"{head}, '{fields(KINDS[kind].cards[0])[0][0]}', c_custkey::DOUBLE, NULL FROM customer{only}")
        if type_:
            rows.append(f"{head}, 'type', NULL, '{type_}' FROM customer{only}")
        if keyword.endswith("_TITLE"):
            rows.append(f"{head}, 'title', NULL, 'Title ' || c_custkey FROM customer{only}")
    return " UNION ALL ".join(rows)


QUERIES["deck_id_lists"], ORACLE["deck_id_lists"] = deck_id_lists, _id_lists_sql()


def deck_segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment sets: quadruples of node ids, those of four zeros left out, a triangle kept."""
    four = lambda *ids: F.concat(*(F.lpad((F.expr(f"c_custkey * 9 + {i}") if i else F.lit(0)).cast("string"), 10, " ") for i in ids))
    deck = Deck(written(spark, sf_dir, [("set_segment", [F.lit("*SET_SEGMENT_TITLE"), F.lit("t"), F.lpad(F.col("c_custkey").cast("string"), 10, " "), four(1, 2, 3, 4), four(0, 0, 0, 0), four(5, 6, 7, 0)])]))
    return deck["set_segment"].select("sid", F.posexplode("segments").alias("place", "s")).select(F.col("sid").cast("bigint").alias("sid"), F.col("place").cast("bigint").alias("place"), *(F.col(f"s.n{i}").cast("bigint").alias(f"n{i}") for i in range(1, 5)))


QUERIES["deck_segment_sets"] = deck_segment_sets
ORACLE["deck_segment_sets"] = """
SELECT c_custkey::BIGINT AS sid, 0::BIGINT AS place, c_custkey * 9 + 1 AS n1, c_custkey * 9 + 2 AS n2, c_custkey * 9 + 3 AS n3, c_custkey * 9 + 4 AS n4 FROM customer WHERE c_custkey > 0
UNION ALL SELECT c_custkey, 1, c_custkey * 9 + 5, c_custkey * 9 + 6, c_custkey * 9 + 7, 0 FROM customer WHERE c_custkey > 0
"""

#: Material keyword -> type, cards that count, and fields that the type has beside ro, e and pr, by (card, column).
_PLASTIC, _COMPOSITE = {"sigy": (0, 4), "etan": (0, 5), "fail": (0, 6), "tdel": (0, 7)}, {"pr": (0, 5), "eb": (0, 3), "ec": (0, 4), "gab": (1, 0), "gca": (1, 2), "xc": (2, 0), "sc": (2, 4)}
MATERIALS = {
    "*MAT_ELASTIC_TITLE": ("ELASTIC", {"pr": (0, 3), "sigy": None}), "*MAT_002": ("ORTHOTROPIC_ELASTIC", {"pr": (0, 5), "eb": (0, 3), "prca": (0, 6), "prcb": (0, 7), "gbc": (1, 1), "aopt": (1, 3)}),
    "*MAT_PLASTIC_KINEMATIC": ("PLASTIC_KINEMATIC", _PLASTIC), "*MAT_RIGID_TITLE": ("RIGID", {"cmo": (1, 0), "con1": (1, 1), "con2": (1, 2)}), "*MAT_024": ("PIECEWISE_LINEAR_PLASTICITY", _PLASTIC),
    "*MAT_FABRIC": ("FABRIC", {"pr": (0, 3)}), "*MAT_055": ("COMPOSITE_DAMAGE", _COMPOSITE), "*MAT_LAMINATED_COMPOSITE_FABRIC": ("LAMINATED_COMPOSITE_FABRIC", _COMPOSITE), "*MAT_059": ("COMPOSITE_FAILURE", _COMPOSITE),
    "*MAT_SPONGE": ("OTHER", {"pr": (0, 3)}),
}


def _material_cell(card: int, column: int) -> str:
    return "c_custkey" if (card, column) == (0, 0) else f"((c_custkey + {card * 8 + column}) % 500) * 0.5"


def _material_cards(kind: str) -> int:
    return MATERIAL_TYPES[kind][1] if kind in MATERIAL_TYPES else 10


def deck_material_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of every type, with the fields that the type has and the raw cells of its last card; two cards more than count."""
    line = lambda i: F.concat(*(F.lpad(F.expr(_material_cell(i, j)).cast("string"), 10, " ") for j in range(8)))
    deck = Deck(written(spark, sf_dir, [(keyword, [F.lit(keyword), *_title("material", keyword), *map(line, range(_material_cards(kind) + 2))]) for keyword, (kind, _) in MATERIALS.items()]))
    rows = F.lit(None)
    for keyword, (kind, own) in MATERIALS.items():
        last = _material_cards(kind) - 1
        numbers = {"mid": F.col("mid"), "ro": F.col("ro"), "e": F.col("e"), "cards_parsed": F.col("cards_parsed"), "last": cell(F.col("cards"), last, 7), "beyond": cell(F.col("cards"), last + 1, 0), **{k: F.col(k) for k in own}}
        rows = F.when(F.col("file") == keyword, _fields(numbers, {"type": F.col("type")})).otherwise(rows)
    return _long(deck["material"], rows)


def _material_sql() -> str:
    rows = []
    for keyword, (kind, own) in MATERIALS.items():
        last = _material_cards(kind) - 1
        cells = {"mid": (0, 0), "ro": (0, 1), "e": (0, 2), "last": (last, 7), **own}
        values = {k: _material_cell(*v) if v else "0" for k, v in cells.items()} | {"cards_parsed": str(last + 1), "beyond": "0"}
        rows += [f"SELECT '{keyword}' AS kind, c_custkey::BIGINT AS id, '{k}' AS field, ({v})::DOUBLE AS number, NULL::VARCHAR AS text FROM customer" for k, v in values.items()]
        rows.append(f"SELECT '{keyword}', c_custkey, 'type', NULL, '{kind}' FROM customer")
    return " UNION ALL ".join(rows)


QUERIES["deck_material_types"], ORACLE["deck_material_types"] = deck_material_types, _material_sql()


def deck_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included paths, as they are written."""
    path = F.concat(F.lit("models/part_"), F.col("c_custkey").cast("string"), F.lit(".k"))
    deck = Deck(written(spark, sf_dir, [(k, [F.lit(k), path]) for k in ("*INCLUDE", "*INCLUDE_PATH", "*INCLUDE_PATH_RELATIVE")]))
    return deck["include"].select("file", "filepath", "is_path_only", "is_relative")


QUERIES["deck_includes"] = deck_includes
ORACLE["deck_includes"] = " UNION ALL ".join(f"SELECT '{k}' AS file, 'models/part_' || c_custkey || '.k' AS filepath, {p} AS is_path_only, {r} AS is_relative FROM customer" for k, p, r in (("*INCLUDE", "false", "false"), ("*INCLUDE_PATH", "true", "false"), ("*INCLUDE_PATH_RELATIVE", "true", "true")))


def deck_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every kind in a deck of all of them."""
    own = [(kind, keyword) for family in FAMILIES.values() for kind, keyword, _ in family]
    return Deck(written(spark, sf_dir, [(keyword, [F.lit(keyword), *_title(kind, keyword), *(_card(kind, i) for i in range(len(KINDS[kind].cards)))]) for kind, keyword in own])).stored().counts().where("n > 0")


_COUNTED: dict[str, int] = {}
for _family in FAMILIES.values():
    for _kind, _, _ in _family:
        _COUNTED[_kind] = _COUNTED.get(_kind, 0) + 1
QUERIES["deck_kind_counts"] = deck_kind_counts
ORACLE["deck_kind_counts"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, {n} * count(*) AS n FROM customer" for k, n in _COUNTED.items())


def deck_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a deck of all kinds of which only parts and controls of time are read."""
    own = [(kind, keyword) for family in FAMILIES.values() for kind, keyword, _ in family]
    lines = written(spark, sf_dir, [(keyword, [F.lit(keyword), *_title(kind, keyword), *(_card(kind, i) for i in range(len(KINDS[kind].cards)))]) for kind, keyword in own])
    return Deck(lines).stored().only(["part", "control_timestep"]).counts().where("n > 0")


QUERIES["deck_only"] = deck_only
ORACLE["deck_only"] = "SELECT 'part' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'control_timestep', count(*) FROM customer"


def deck_element_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells and solids together, with their part and how many nodes they have."""
    deck = Deck(written(spark, sf_dir, [(kind, [F.lit(f"*{kind.upper()}"), _card(kind, 0)]) for kind in ("element_shell", "element_solid", "element_beam")]))
    return deck["element"].where("type <> 'beam'").select("eid", "pid", "type", F.col("node_count").cast("int").alias("node_count"))


QUERIES["deck_element_union"] = deck_element_union
ORACLE["deck_element_union"] = " UNION ALL ".join(f"SELECT {_number(0, 'i')}::INT AS eid, {_number(1, 'i')}::INT AS pid, '{t}' AS type, 8::INT AS node_count FROM customer" for t in ("shell", "solid"))


def record_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and JSON details of parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pid"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"))
    return views.details(p).select("details", F.get_json_object("details", "$.pid").cast("int").alias("pid")).join(p.select("pid", views.label("part", p.columns).alias("label")), "pid").select("pid", "label", "details")


QUERIES["record_views"] = record_views
ORACLE["record_views"] = "SELECT p_partkey::INT AS pid, CASE WHEN p_size % 2 = 0 THEN p_partkey || ': ' || p_name ELSE 'Part ' || p_partkey END AS label, '{\"pid\":' || p_partkey || ',\"title\":\"' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || '\"}' AS details FROM part"
