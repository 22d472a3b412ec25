"""Keyword decks as DataFrames: lines with numbers and sections, and typed records of every kind."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.fields import double_field, int_field, text_field
from tessera.sources import deck_source
from tessera.sources.cards import CONTACT_TYPES, KINDS, MATERIAL_TYPES, TEN_IDS, UNKNOWN_MATERIAL_CARDS, Kind, fields
from tessera.sources.folders import shared_dir

#: Lines that one window of the section carry takes; longer files are carried block by block.
BLOCK_LINES = 100_000
#: Scans for parts take larger numbers for something else, unless they are told how large ids may be.
PIDS_BELOW = 1_000_000


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, line_no and line of text decks. line_no grows along the file and says no more: large files are read in parts.

    A line's number is where its part of the file begins, in bytes, and its place in the part, which is less than the
    part's bytes. Parts may be read in any order.
    """
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.rtrim(F.col("value")).alias("line"))
    first = rows.groupBy("file", "start").agg(F.min("id").alias("first"))  # a row for each part
    return rows.join(first, ["file", "start"]).select("file", (F.col("start") + F.col("id") - F.col("first")).alias("line_no"), "line")


def lines_of_text(spark: SparkSession, content: str, name: str = "text") -> DataFrame:
    """file, line_no and line of a deck held in a string."""
    whole = spark.createDataFrame([(name, content)], "file string, content string")
    return whole.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")


def is_keyword(line: Column) -> Column:
    return line.startswith("*")


def is_comment(line: Column) -> Column:
    return line.startswith("$")


def is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def carried(lines: DataFrame, head: Column) -> DataFrame:
    """Lines with ``own``: the last ``head``, a struct that begins with a line number, that isn't null up to each line of its file.

    It is carried in two steps, so that a file of any size is windowed in blocks of lines: the last head
    of each block goes to the following blocks, then each block carries its own. The lines' own heads stay as ``head``.
    """
    marked = lines.withColumn("head", head).withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    blocks = marked.groupBy("file", "block").agg(F.max("head").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(before, ["file", "block"]).withColumn("own", F.coalesce(F.last("head", ignorenulls=True).over(within), F.col("carried"))).drop("block", "carried")


def sections(lines: DataFrame) -> DataFrame:
    """Data lines with the upper-cased keyword of their section, its ``kind``, and ``section``, the number of the keyword's line.

    A keyword holds until the next one. Comments, blank lines and lines before any keyword are left out. Only keyword lines are
    matched with the kinds; keywords of no kind have a null one.
    """
    keyword = F.upper(F.trim("line"))
    head = F.when(is_keyword(F.col("line")), F.struct(F.col("line_no").alias("section"), keyword.alias("keyword"), kind_of(keyword).alias("kind")))
    data = carried(lines, head).where(F.col("own").isNotNull() & F.col("head").isNull() & ~is_comment(F.col("line")) & ~is_blank(F.col("line")))
    return data.select("file", "line_no", "line", "own.section", "own.keyword", "own.kind")


def kind_of(keyword: Column) -> Column:
    """The first kind whose pattern an upper-cased keyword fits."""

    def found(one: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, own in reversed(KINDS.items()):
            kind = F.when(one.rlike(own.keyword), name).otherwise(kind)
        return kind

    return F.get(F.transform(F.array(keyword), found), F.lit(0))  # a lambda: so many patterns are too long for compiled code


def keyword_lines(lines: DataFrame) -> DataFrame:
    return lines.where(is_keyword(F.col("line"))).select("file", "line_no", F.upper(F.trim("line")).alias("keyword"))


def decode_card(line: Column, card: str) -> list[Column]:
    """Typed columns of one card's line."""
    by = {"i": int_field, "d": double_field, "s": text_field}
    return [by[kind](line, start, width).alias(name) for name, kind, start, width in fields(card)]


def type_of(keyword: Column, kind: Kind) -> Column:
    """The first type whose mark the keyword holds."""
    found = F.lit("OTHER")
    for mark, name in reversed(kind.types):
        found = F.when(F.contains(keyword, F.lit(mark)), name).otherwise(found)
    return found


def contact_type(keyword: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(keyword, r"^\*CONTACT_", ""), r"(_ID|_TITLE|_MPP)+$", "")
    found = F.lit("OTHER")
    for known in reversed(CONTACT_TYPES):
        found = F.when(name.startswith(known), known).otherwise(found)
    return found


def material_name(keyword: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(keyword, r"^\*MAT_", ""), r"_TITLE$", "")


def material_type(keyword: Column) -> tuple[Column, Column]:
    """Type of a material keyword and how many cards it has."""
    name, kind, cards = material_name(keyword), F.lit("OTHER"), F.lit(UNKNOWN_MATERIAL_CARDS)
    for known, (names, count) in MATERIAL_TYPES.items():
        kind, cards = F.when(name.isin(*names), known).otherwise(kind), F.when(name.isin(*names), count).otherwise(cards)
    return kind, cards


def _titled(kind: Kind) -> Column:
    if kind.titled == "always":
        return F.lit(1)
    return F.when(F.col("keyword").rlike("_(TITLE|ID)(_MPP)?$"), 1).otherwise(0) if kind.titled else F.lit(0)


def records(data: DataFrame, name: str, every: bool = False) -> DataFrame:
    """Records of one kind from ``sections``, with file, line_no and section.

    With ``every``, kinds of which only the first record of a section counts give all of them.
    """
    kind = KINDS[name]
    own = data.where(F.col("kind") == name)
    key = ["file", "section"]
    if kind.mode == "each":
        found = own.select("file", "line_no", "section", "keyword", *decode_card(F.col("line"), kind.cards[0]))
        return _finish(found, name, kind)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))
    numbered = own.withColumn("place", place)
    if kind.mode == "first" and not every:  # Spark keeps no more lines of a section than these before it deals them
        numbered = numbered.where(F.col("place") <= len(kind.cards) + 1)
    numbered = numbered.withColumn("card", F.col("place") - 1 - _titled(kind)).drop("place")
    title = F.max(F.when(F.col("card") == -1, F.trim("line")))
    if kind.mode == "list":
        head = numbered.groupBy(*key).agg(F.min("line_no").alias("line_no"), F.first("keyword").alias("keyword"), title.alias("title"), F.max(F.when(F.col("card") == 0, F.col("line"))).alias("_head"), F.array_sort(F.collect_list(F.when(F.col("card") >= 0, F.struct("card", "line")))).alias("_lines"))
        return _finish(_lists(head, name, kind), name, kind)
    size = len(kind.cards)
    if kind.titled == "always":  # a title and its cards repeat
        numbered = numbered.withColumn("card", F.col("card") + 1)
        size += 1
    group = numbered.withColumn("record", F.floor(F.col("card") / size)).withColumn("place", F.pmod(F.col("card"), F.lit(size)))
    if not every:
        group = group.where("record = 0 OR card < 0")
    place = lambda i: F.max(F.when((F.col("place") == i) & (F.col("card") >= 0), F.col("line")))
    shift = int(kind.titled == "always")
    first = F.max(F.when((F.col("place") == 0) & (F.col("card") >= 0), F.trim("line"))) if shift else title
    cards = group.withColumn("record", F.greatest("record", F.lit(0))).groupBy(*key, "record").agg(
        F.min("line_no").alias("line_no"), F.first("keyword").alias("keyword"), first.alias("title"), *(place(i + shift).alias(f"_card{i}") for i in range(len(kind.cards)))
    )
    whole = cards.where(F.col(f"_card{len(kind.cards) - 1}").isNotNull())  # a record cut short by the next keyword is lost
    decoded = [c for i, card in enumerate(kind.cards) for c in decode_card(F.col(f"_card{i}"), card)]
    return _finish(whole.select("file", "line_no", "section", "keyword", "title", *decoded), name, kind)


def _lists(head: DataFrame, name: str, kind: Kind) -> DataFrame:
    """Header fields, and what all the later lines of a section hold, in their order."""
    later = F.filter("_lines", lambda x: x["card"] >= (0 if not kind.cards[0] or name == "material" else 1))
    columns = ["file", "line_no", "section", "keyword", "title", *decode_card(F.col("_head"), kind.cards[0])]
    places = fields(kind.cards[1])
    if name == "curve":
        points = F.transform(later, lambda x: F.struct(double_field(x["line"], 0, 20).alias("a"), double_field(x["line"], 20, 20).alias("o")))
        return head.select(*columns, points.alias("points")).where("lcid > 0")
    if name == "material":
        cards = F.transform(F.slice(later, F.lit(1), material_type(F.col("keyword"))[1]), lambda x: F.array(*[double_field(x["line"], a, w) for _, _, a, w in places]))
        return head.select(*columns, cards.alias("cards")).withColumn("cards_parsed", F.size("cards"))
    if name == "set_segment":
        segments = F.transform(later, lambda x: F.struct(*[int_field(x["line"], a, w).alias(n) for n, _, a, w in places]))
        kept = F.filter(segments, lambda s: (s["n1"] != 0) | (s["n2"] != 0) | (s["n3"] != 0) | (s["n4"] != 0))
        return head.select(*columns, kept.alias("segments")).where("sid > 0 AND size(segments) > 0")
    ids = F.filter(F.flatten(F.transform(later, lambda x: F.array(*[int_field(x["line"], a, w) for _, _, a, w in places]))), lambda i: i > 0)
    found = head.select(*columns, ids.alias("ids")).where("size(ids) > 0")
    return found.where("sid > 0") if name.startswith("set_") else found


def _finish(found: DataFrame, name: str, kind: Kind) -> DataFrame:
    """What a kind has besides its fields."""
    if name.startswith("element_"):
        ids = F.array(*[F.col(f"n{i}") for i in range(1, 9)])
        last = F.coalesce(F.array_max(F.transform(ids, lambda x, i: F.when(x > 0, i + 1).otherwise(0))), F.lit(0))
        least = 2 if name == "element_beam" else 3
        count = F.when(last >= least, last).otherwise(0)
        return found.select("file", "line_no", "section", "eid", "pid", F.lit(name.removeprefix("element_")).alias("type"), count.cast("byte").alias("node_count"), F.when(count > 0, F.slice(ids, F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("nodes"))
    if name == "contact":
        return found.withColumn("type", contact_type(F.col("keyword"))).drop("keyword")
    if name == "material":
        return _material(found.withColumn("type", material_type(F.col("keyword"))[0]).withColumn("type_name", material_name(F.col("keyword"))).drop("keyword"))
    if name == "include":
        return found.withColumn("is_path_only", F.contains("keyword", F.lit("PATH"))).withColumn("is_relative", F.contains("keyword", F.lit("RELATIVE"))).drop("keyword")
    if kind.types:
        found = found.withColumn("type", type_of(F.col("keyword"), kind))
    return found.drop("keyword")


def cell(cards: Column, card: int, column: int) -> Column:
    """A raw card's number; 0 beyond the cards or columns there are."""
    return F.coalesce(F.get(F.get(cards, card), column), F.lit(0.0))


def _material(found: DataFrame) -> DataFrame:
    c = lambda i, j: cell(F.col("cards"), i, j)
    kind = F.col("type")
    plastic, ortho = kind.isin("PIECEWISE_LINEAR_PLASTICITY", "PLASTIC_KINEMATIC"), kind == "ORTHOTROPIC_ELASTIC"
    composite, rigid = kind.isin("COMPOSITE_DAMAGE", "LAMINATED_COMPOSITE_FABRIC", "COMPOSITE_FAILURE"), kind == "RIGID"
    own = {
        "pr": F.when(ortho | composite, c(0, 5)).otherwise(F.col("pr")), "sigy": F.when(plastic, c(0, 4)), "etan": F.when(plastic, c(0, 5)), "fail": F.when(plastic, c(0, 6)), "tdel": F.when(plastic, c(0, 7)),
        "eb": F.when(ortho | composite, c(0, 3)), "ec": F.when(ortho | composite, c(0, 4)), "prca": F.when(ortho, c(0, 6)), "prcb": F.when(ortho, c(0, 7)), "gab": F.when(ortho | composite, c(1, 0)),
        "gbc": F.when(ortho | composite, c(1, 1)), "gca": F.when(ortho | composite, c(1, 2)), "aopt": F.when(ortho, c(1, 3)), "cmo": F.when(rigid, c(1, 0)), "con1": F.when(rigid, c(1, 1)), "con2": F.when(rigid, c(1, 2)),
        "xc": F.when(composite, c(2, 0)), "xt": F.when(composite, c(2, 1)), "yc": F.when(composite, c(2, 2)), "yt": F.when(composite, c(2, 3)), "sc": F.when(composite, c(2, 4)),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in own.items()})


class Deck:
    """A deck's records by kind, each a DataFrame that is decoded when it is used.

    With ``only``, a list of kinds, lines of other kinds are left out, and those kinds have no records. Each kind that is asked for scans the
    lines; ``stored`` does that once for all kinds.
    """

    def __init__(self, lines: DataFrame | None, only: Sequence[str] | None = None, data: DataFrame | None = None) -> None:
        """Of lines (file, line_no, line), or of data lines that have their section and kind already."""
        self.lines = lines
        self.data = sections(lines) if data is None else data
        if only is not None:
            self.data = self.data.where(F.col("kind").isin(list(only)))
        self._lines_of = lambda kind: self.data

    @classmethod
    def open(cls, spark: SparkSession, path: str, only: Sequence[str] | None = None, range_bytes: int = deck_source.RANGE_BYTES) -> Deck:
        """Through the data source ``deck``: each kind that is asked for is read alone, other kinds are left out as they are read. FileNotFoundError if there is no deck at the path."""
        deck = cls(None, None, deck_source.load(spark, path, None if only is None else list(only), range_bytes))
        deck._lines_of = lambda kind: deck_source.load(spark, path, [kind] if only is None or kind in only else [], range_bytes)
        return deck

    def stored(self, path: str | None = None) -> Deck:
        """The same deck with its lines written once, a folder for each kind, so that a kind is read alone; into the shared folder without path.

        Lines of no kind stay, for scans that look for other keywords.
        """
        at = path or f"{shared_dir(self.data.sparkSession)}/deck-{uuid.uuid4().hex}"
        self.data.write.partitionBy("kind").parquet(at)
        return Deck.of_store(self.data.sparkSession, at)

    def only(self, kinds: Sequence[str]) -> Deck:
        """The deck with records of these kinds alone."""
        return Deck(None, kinds, self.data)

    @classmethod
    def of_store(cls, spark: SparkSession, path: str) -> Deck:
        """A deck that ``stored`` wrote."""
        return cls(None, None, spark.read.schema("file string, line_no bigint, line string, section bigint, keyword string, kind string").parquet(path))

    @classmethod
    def read(cls, spark: SparkSession, paths: str | Sequence[str], only: Sequence[str] | None = None) -> Deck:
        return cls(read_lines(spark, paths), only)

    @classmethod
    def parse(cls, spark: SparkSession, content: str, only: Sequence[str] | None = None) -> Deck:
        return cls(lines_of_text(spark, content), only)

    def __getitem__(self, kind: str) -> DataFrame:
        if kind == "element":
            return self["element_shell"].unionByName(self["element_solid"]).unionByName(self["element_beam"])
        return records(self._lines_of(kind), kind)

    def counts(self) -> DataFrame:
        """Records of every kind. Lines are counted by keyword or section first, and only these are matched with the kinds."""
        names = list(KINDS)
        of = lambda chosen: F.col("kind").isin([n for n in names if chosen(KINDS[n])])
        each = of(lambda k: k.mode == "each")
        found = self.data.where(each).groupBy("kind").agg(F.count("*").alias("n"))
        # of the others a section holds one record at most, if it has enough lines and ids
        titled = F.when(of(lambda k: k.titled == "always"), 1).when(F.col("keyword").rlike("_(TITLE|ID)(_MPP)?$") & of(lambda k: k.titled == "suffix"), 1).otherwise(0)
        most = F.coalesce(*(F.when(of(lambda k, n=n: k.mode == "first" and len(k.cards) == n), n) for n in {len(k.cards) for k in KINDS.values()}), F.lit(1)) + titled
        an_id = F.greatest(*(int_field(F.col("line"), a, w) for _, _, a, w in fields(TEN_IDS)))
        # lines of a section in order are only needed up to the first card of a list
        lines = self.data.where(~each)
        bare = titled + F.when(of(lambda k: k.mode == "list" and not k.cards[0]), 0).otherwise(1)
        card = F.row_number().over(Window.partitionBy("file", "section").orderBy("line_no"))
        top = lines.withColumn("place", card).where(F.col("place") <= 2).groupBy("file", "section").agg(*(F.max(F.when(F.col("place") == i, F.col("line"))).alias(f"line{i}") for i in (1, 2)), *(F.max(F.when(F.col("place") == i, F.col("line_no"))).alias(f"at{i}") for i in (1, 2)))
        whole = lines.withColumn("id", F.when(of(lambda k: k.mode == "list"), an_id)).groupBy("file", "section", "kind", "keyword").agg(F.count("*").alias("n"), F.max("id").alias("ids"))
        # ids count beyond a list's title and head
        later = lines.where(of(lambda k: k.mode == "list")).join(top.select("file", "section", "at1", "at2"), ["file", "section"]).withColumn("skip", F.when(bare == 2, F.coalesce("at2", F.lit(2**62))).when(bare == 1, F.col("at1")))
        later = later.where(F.col("skip").isNull() | (F.col("line_no") > F.col("skip"))).groupBy("file", "section").agg(F.max(an_id).alias("ids"))
        joined = whole.drop("ids").join(top, ["file", "section"]).join(later, ["file", "section"], "left")
        first = int_field(F.when(titled == 1, F.col("line2")).otherwise(F.col("line1")), 0, 10)
        sets = F.col("kind").startswith("set_")
        fine = (F.col("n") >= most) & (~(sets | F.col("kind").isin("extra_nodes", "database_history")) | (F.coalesce("ids", F.lit(0)) > 0)) & (~(sets | (F.col("kind") == "curve")) | (F.coalesce(first, F.lit(0)) > 0))
        found = found.unionByName(joined.where(fine).groupBy("kind").agg(F.count("*").alias("n")))
        every = self.data.sparkSession.createDataFrame([(n,) for n in names], "kind string")
        return every.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))

    def register(self, prefix: str = "deck_") -> None:
        """A temporary view for every kind."""
        for kind in KINDS:
            self[kind].createOrReplaceTempView(prefix + kind)

    def part_names(self, below: int = PIDS_BELOW) -> DataFrame:
        """pid and name of parts, comma or blank separated, 0 < pid < below; of several the last."""
        own = self.data.where(F.col("keyword").rlike(r"^\*PART(_TITLE)?\s*$"))
        order = Window.partitionBy("file", "section").orderBy("line_no")
        pairs = own.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("line").over(order)).where("i % 2 = 0 AND next IS NOT NULL")
        pid = F.regexp_extract("next", r"^\s*(\d+)", 1).try_cast("int")
        return pairs.select(pid.alias("pid"), F.trim("line").alias("name"), "line_no").where((F.col("pid") > 0) & (F.col("pid") < below)).groupBy("pid").agg(F.max_by("name", "line_no").alias("name"))

    def part_ids(self, below: int = PIDS_BELOW) -> DataFrame:
        """Distinct pids, 0 < pid < below, from three places: *PART cards, the first line of each *ELEMENT_SOLID section, and *SET_PART lists."""
        number = lambda line, pattern: F.regexp_extract(line, pattern, 1).try_cast("bigint")
        order = Window.partitionBy("file", "section").orderBy("line_no")
        own = self.data.where(F.col("keyword").rlike(r"^\*PART(_TITLE)?\s*$"))
        placed = own.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("line").over(order))
        part = placed.where((F.col("i") % 2 == 0) & F.col("next").isNotNull()).select(number("next", r"^\s*(\d+)").alias("pid"))
        # the first line of a section that may hold nearly all of a deck, and the lines beyond a set's head, without sorting sections
        first = self.data.where(F.col("keyword").startswith("*ELEMENT_SOLID")).groupBy("file", "section").agg(F.min_by("line", "line_no").alias("line"))
        solid = first.select(number("line", r"^\s*\d+\s*,?\s*(\d+)").alias("pid"))
        listed = self.data.where(F.col("keyword").startswith("*SET_PART"))
        place = listed.withColumn("i", F.row_number().over(order)).where(F.col("i") <= 2)
        head = place.where(F.col("i") == F.when(F.col("keyword").endswith("_TITLE"), 2).otherwise(1)).select("file", "section", F.col("line_no").alias("head"))
        later = listed.join(head, ["file", "section"]).where("line_no > head")
        sets = later.select(F.explode(F.regexp_extract_all("line", F.lit(r"(\d+)"), F.lit(1))).alias("pid")).select(F.col("pid").try_cast("bigint").alias("pid"))
        return part.union(solid).union(sets).where((F.col("pid") > 0) & (F.col("pid") < below)).distinct()

    def part_ids_quick(self, below: int = PIDS_BELOW) -> DataFrame:
        """Distinct pids, 0 < pid < below: the first value of the line after each *PART keyword, if it is a number."""
        own = self.data.where(F.col("keyword").startswith("*PART"))
        first = own.groupBy("file", "section").agg(F.min_by("line", "line_no").alias("line"))
        pid = F.get(F.split(F.trim("line"), r"[,\s]+"), 0).try_cast("bigint")
        return first.select(pid.alias("pid")).where((F.col("pid") > 0) & (F.col("pid") < below)).distinct()

    def part_ids_found(self, below: int = PIDS_BELOW) -> DataFrame:
        """pids of the first scan that finds any: part names, then the three places, then the quick one."""
        scans = [self.part_names(below).select(F.col("pid").cast("bigint").alias("pid")), self.part_ids(below), self.part_ids_quick(below)]
        return next((x for x in scans if not x.isEmpty()), scans[-1])


def text_cells(data: DataFrame, kind: str) -> DataFrame:
    """Lines of one kind's sections as ``cells``, an array of trimmed texts, one for each field of the first card: file, line_no, section, cells.

    A cell beyond the line's end is blank. Single cells are ``F.get("cells", j)``.
    """
    own = data.where(F.col("kind") == kind)
    return own.select("file", "line_no", "section", F.array(*(text_field(F.col("line"), a, w) for _, _, a, w in fields(KINDS[kind].cards[0]))).alias("cells"))
