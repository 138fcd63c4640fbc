"""Bring tables and texts into the form that scans read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT_CHARS = 1_232_500
CHUNK_CHARS = 1_000
SAMPLE_BUCKETS = 65_536
# Counts below spark.sql.optimizer.windowGroupLimitThreshold are limited before the shuffle.
SKETCH_ROWS = 1_000

# Characters a string strip removes: every Unicode blank and the old text separators.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

CSV_DELIMITERS = (",", ";", "\t", "|")
# Characters at the start of a CSV text that tell its delimiter.
HEAD_CHARS = 65_536
JSON_LEVELS = 64
# Records of a file that go to one task together, and pieces of work for each core.
PIECE_RECORDS = 500
TASKS_PER_CORE = 4
TOKEN_BREAK = "[ \n]"
MIN_TOKEN_CHARS = 2
WORD_OR_PUNCTUATION = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def melt_columns(
    df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = ()
) -> DataFrame:
    """Wide table to rows (ids, column_name, value), every value as string."""
    names = [c for c in (columns or df.columns) if c not in ids]
    held = [quoted(c) for c in ids]
    wide = df.select(*held, *[F.col(quoted(name)).cast("string").alias(name) for name in names])
    return wide.unpivot(held, [quoted(name) for name in names], "column_name", "value")


def quoted(name: str) -> str:
    """A column's name as an identifier, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def melt_tables(
    tables: Mapping[str, DataFrame],
    columns: Sequence[str] | None = None,
    ids: Mapping[str, str] | None = None,
) -> DataFrame:
    """Several tables (sheets) as one long table (table, row_id, column_name, value)."""
    melted = []
    for name, df in tables.items():
        key = (ids or {}).get(name)
        row, at = F.col(quoted(key)) if key else F.monotonically_increasing_id(), free_name(df, "_row")
        wanted = [c for c in (columns or df.columns) if c in df.columns and c != key]
        long = melt_columns(df.withColumn(at, row), wanted, ids=[at])
        melted.append(
            long.select(F.lit(name).alias("table"), F.col(at).alias("row_id"), "column_name", "value")
        )
    return reduce(DataFrame.unionByName, melted)


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def clean_values(df: DataFrame, mode: str = "csv", ids: Sequence[str] = ()) -> DataFrame:
    """Melt a table, strip its values and drop the empty ones.

    ``csv`` takes every column as text, ``json`` strings and numbers, ``xlsx`` strings only.
    """
    if mode not in ("csv", "json", "xlsx"):
        raise ValueError(f"unknown mode {mode!r}")

    def keeps(data_type: T.DataType) -> bool:
        if mode == "csv" or isinstance(data_type, T.StringType):
            return True
        return mode == "json" and isinstance(data_type, (T.NumericType, T.BooleanType))

    names = [f.name for f in df.schema.fields if f.name not in ids and keeps(f.dataType)]
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    titled = {n: F.initcap(F.col(quoted(n)).cast("string")) for n in names if n in flags}
    return strip_values(melt_columns(df.withColumns(titled), names, ids))


def strip_values(values: DataFrame, col: str = "value") -> DataFrame:
    return values.withColumn(col, strip(F.col(col))).filter(F.col(col) != "")


def extract_key(df: DataFrame, key: str, ids: Sequence[str] = ()) -> DataFrame:
    """Scalars stored under a key at any depth of nested records.

    The schema is walked on the driver; the values come from one array expression. A matched
    key is not searched further, lists are searched for the records they hold.
    """
    found = [path for f in df.schema.fields for path in _key_arrays(F.col(f"`{f.name}`"), f, key)]
    if not found:
        found = [F.array().cast("array<string>")]
    values = F.filter(F.flatten(F.array(*found)), lambda v: v.isNotNull())
    return df.select(*ids, F.explode(values).alias("value"))


def _key_arrays(value: Column, at: T.StructField, key: str) -> list[Column]:
    data_type = at.dataType
    if at.name == key:
        if isinstance(data_type, T.BooleanType):
            return [F.array(F.initcap(value.cast("string")))]
        if isinstance(data_type, (T.StringType, T.NumericType)):
            return [F.array(value.cast("string"))]
        return []
    if isinstance(data_type, T.StructType):
        return _record_arrays(value, data_type, key)
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType):
        record_type = data_type.elementType
        if not _record_arrays(F.lit(None), record_type, key):
            return []

        def inside(record: Column) -> Column:
            return F.flatten(F.array(*_record_arrays(record, record_type, key)))

        items = F.flatten(F.transform(value, inside))
        return [F.coalesce(items, F.array().cast("array<string>"))]
    return []


def _record_arrays(record: Column, record_type: T.StructType, key: str) -> list[Column]:
    return [
        array
        for f in record_type.fields
        for array in _key_arrays(record.getField(f.name), f, key)
    ]


def sample_values(
    values: DataFrame,
    sample_size: int | float | None,
    by: Sequence[str] = ("column_name",),
    key: Sequence[str] = ("row_id",),
    seed: int = 0,
) -> DataFrame:
    """Sample per column: an int is a number of values, a float a share of them.

    Values are ordered by a hash of their key, so a rerun draws the same sample. For a count
    below SKETCH_ROWS each partition keeps the least hashes of each column, as many as asked for,
    and only these are shuffled and ranked: the values are read once. For larger counts a
    histogram of hash buckets finds how far each column must be read, and only the rows up to
    that bucket are ranked. No column is sorted or gathered as a whole.
    """
    if sample_size is None:
        return values
    hashed = values.withColumn("_hash", F.xxhash64(*by, *key, F.lit(seed)))
    if isinstance(sample_size, float):
        # The hash without its sign is a number of 63 bits; its share of them is even.
        place = F.col("_hash").bitwiseAND(F.lit((1 << 63) - 1))
        if sample_size >= 1:
            return values
        return hashed.filter(place < F.lit(int(max(sample_size, 0.0) * (1 << 63)))).drop("_hash")
    bucketed = hashed.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(SAMPLE_BUCKETS)))
    ranked = Window.partitionBy(*by).orderBy("_bucket", "_hash", *key)
    if sample_size < SKETCH_ROWS:
        # Spark keeps the first rows of each group before the shuffle, and again after it.
        kept = bucketed.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= sample_size)
        return kept.select(*values.columns)
    running = Window.partitionBy(*by).orderBy("_bucket")
    histogram = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cut = (
        histogram.withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .filter(F.col("_before") < sample_size)
        .groupBy(*by)
        .agg(F.max("_bucket").alias("_cut"))
    )
    return (
        bucketed.join(cut, list(by))
        .filter(F.col("_bucket") <= F.col("_cut"))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= sample_size)
        .select(*values.columns)
    )


def table_cells(
    files: DataFrame, keys: Sequence[str], name: str = "file_name", col: str = "text"
) -> DataFrame:
    """Cells (keys, column_name, row_id, value) of CSV and JSON files, one row of ``files`` each.

    JSON may be an array, lines or one object; members of nested objects are columns of their
    own, named by their path. Cells beyond the header's width have no column name. Formats other
    than these have no cells. A file is one value; tables too large for that are read as tables
    and melted.
    """
    return file_cells(files, keys, name, col).where(~F.col("broken")).drop("broken")


def file_cells(
    files: DataFrame, keys: Sequence[str], name: str = "file_name", col: str = "text"
) -> DataFrame:
    """``table_cells``, and with ``broken`` true the pieces of the records that do not parse.

    These are JSON lines, or lines of a JSON text, that are no value by themselves in a file that
    is none as a whole; and lines with an open quote in a CSV file whose quotes do not match. The
    pieces are what stands between quotes, delimiters and brackets.
    """
    body = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "^\ufeff", "")
    source = files.select(
        F.struct(*[F.col(quoted(k)).alias(k) for k in keys]).alias("keys"),
        F.lower(F.substring_index(F.coalesce(F.col(name), F.lit("")), ".", -1)).alias("kind"),
        F.replace(body, F.lit("\r\n"), F.lit("\n")).alias("body"),
    )
    csv = _csv_cells(source.where("kind = 'csv'"))
    cells = csv.unionByName(_json_cells(source.where("kind = 'json'")))
    held = [F.col("keys").getField(k).alias(k) for k in keys]
    return cells.select(*held, "column_name", "row_id", "value", "broken")


# Control characters that stand between the cells and records of a CSV text, and for quotes that
# are part of a value. Texts that hold these characters themselves get blanks for them.
CELL, RECORD, LITERAL_QUOTE = "\x1f", "\x1e", "\x1d"


def _csv_cells(files: DataFrame) -> DataFrame:
    """Cells of CSV texts of any header, delimiter and width, in linear time.

    Quotes part a text into what stands outside and, at every second place, inside of them. Only
    outside, delimiters and line feeds become control characters, at which the text is then
    split. A quote with a value on both sides is no delimiter of values, but part of one.

    The arrays are exploded with ``outer``, though they are never empty: for plain generators the
    optimizer adds a test for empty arrays, which repeats all expressions below.
    """
    text = F.regexp_replace("body", "[\x1d-\x1f]", " ")
    head = F.substring_index(F.regexp_replace(F.substring(text, 1, HEAD_CHARS), '"[^"]*+"', ""), "\n", 1)
    ranks = [
        F.struct(
            (F.length(head) - F.length(F.replace(head, F.lit(d)))).alias("n"),
            F.lit(-i).alias("i"),
            F.lit(d).alias("d"),
        )
        for i, d in enumerate(CSV_DELIMITERS)
    ]
    edge = F.concat(F.lit('[\n"'), "d", F.lit("]"))
    inner = F.concat(F.lit("(?<!"), edge, F.lit(')(?<!^)"(?!'), edge, F.lit("|$)"))
    prepared = (
        files.select("keys", text.alias("raw"), F.array_max(F.array(*ranks))["d"].alias("d"))
        .withColumn("inner", inner)
        .select("keys", "d", F.regexp_replace("raw", F.col("inner"), F.lit(LITERAL_QUOTE)).alias("text"))
    )

    def marked(s: Column) -> Column:
        outside = F.transform(
            F.split(s, '"'),
            lambda x, i: F.when(
                i % 2 == 0, F.replace(F.replace(x, F.col("d"), F.lit(CELL)), F.lit("\n"), F.lit(RECORD))
            ).otherwise(x),
        )
        return F.array_join(outside, '"')

    def open_quote(s: Column) -> Column:
        return (F.length(s) - F.length(F.replace(s, F.lit('"')))) % 2 == 1

    def record(s: Column, broken: Column) -> Column:
        return F.struct(s.alias("s"), broken.alias("broken"))

    def cells(s: Column) -> Column:
        def value(c: Column) -> Column:
            whole = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
            bare = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
            return F.replace(F.when(whole, bare).otherwise(c), F.lit(LITERAL_QUOTE), F.lit('"'))

        return F.transform(F.split(s, CELL), value)

    by_record = F.transform(F.split(marked(F.col("text")), RECORD), lambda s: record(s, F.lit(False)))
    by_line = F.transform(
        F.split("text", "\n"),
        lambda s: F.when(
            open_quote(s), record(F.replace(F.replace(s, F.lit('"')), F.col("d"), F.lit(CELL)), F.lit(True))
        ).otherwise(record(marked(s), F.lit(False))),
    )
    # The header is taken before the records part, so that no record carries all others along.
    parted = prepared.select(
        "keys", F.when(open_quote(F.col("text")), by_line).otherwise(by_record).alias("records")
    ).withColumn("names", cells(F.get("records", F.lit(0))["s"]))
    records = _dealt(parted, ["keys", "names"], "records", "r")
    rows = records.where("r.s <> ''").select(
        "keys", "names", "at", F.col("r.broken").alias("broken"), F.posexplode_outer(cells(F.col("r.s"))).alias("i", "value")
    )
    column = F.when(~F.col("broken"), F.get("names", F.col("i")))
    return rows.where("at > 0 OR broken").select(
        "keys", column.alias("column_name"), (F.col("at") - 1).cast("long").alias("row_id"), "value", "broken"
    )


def _json_cells(files: DataFrame) -> DataFrame:
    """Cells of JSON texts of any form, level by level as VARIANT.

    Values nested deeper than JSON_LEVELS come as their JSON text. Objects that name a member
    twice are broken.
    """
    spark = files.sparkSession
    whole = _strict_json(F.col("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: strip(x) != "")
    units = F.when(whole.isNotNull(), F.array("body")).otherwise(lines)
    rows = (
        files.select("keys", whole.isNotNull().alias("whole"), units.alias("units"))
    )
    rows = (
        _dealt(rows, ["keys", "whole"], "units", "unit")
        .where("unit <> ''")
        .withColumn("value", _strict_json(F.col("unit")))
    )
    pieces = F.filter(
        F.transform(F.split("unit", '"'), lambda x: F.trim(x, F.lit(" \t:,{}[]"))), lambda x: x != ""
    )
    broken = rows.where(F.col("value").isNull()).select(
        "keys",
        F.lit(None).cast("string").alias("column_name"),
        F.col("at").cast("long").alias("row_id"),
        F.explode(pieces).alias("value"),
        F.lit(True).alias("broken"),
    )
    depth = files.agg(F.max(_json_depth(F.col("body")))).first()[0] or 0
    found = rows.where(F.col("value").isNotNull()).select("keys", "whole", "at", F.lit("").alias("path"), "value")
    for level in range(min(depth, JSON_LEVELS) + 1):
        # Only single values go along with what is exploded, so that no element carries its array.
        single = F.when(~_nested(F.col("value")), F.col("value"))
        held = found.withColumn("single", single).withColumnRenamed("value", "held")
        inside = held.lateralJoin(spark.tvf.variant_explode_outer(F.col("held").outer()))
        # Level 0 takes off the brackets put around every unit; level 1 holds a text's records.
        element = F.col("whole") & F.col("key").isNull() & F.lit(level == 1)
        found = inside.select(
            "keys",
            "whole",
            F.when(element, F.coalesce("pos", "at")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("key").isNull(), F.col("path"))
            .when(F.col("path") == "", F.col("key"))
            .otherwise(F.concat("path", F.lit("."), "key"))
            .alias("path"),
            F.coalesce("single", "value").alias("value"),
        )
    kind = F.schema_of_variant("value")
    shown = F.col("value").cast("string")
    return (
        found.select(
            "keys",
            F.col("path").alias("column_name"),
            F.col("at").cast("long").alias("row_id"),
            F.when(kind == "BOOLEAN", F.initcap(shown)).otherwise(shown).alias("value"),
            F.lit(False).alias("broken"),
        )
        .where("value IS NOT NULL")
        .unionByName(broken)
    )


def _dealt(files: DataFrame, held: Sequence[str], records: str, name: str) -> DataFrame:
    """Elements of the array ``records`` (held, at, name), dealt out to all tasks in pieces.

    A file is split into its records by one task; what is done with the records is not. A row that
    moves holds PIECE_RECORDS records, so that these do not all carry the keys of their file.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    starts = F.sequence(F.lit(0), F.greatest(F.size(records) - 1, F.lit(0)), F.lit(PIECE_RECORDS))
    pieces = F.transform(
        starts, lambda i: F.struct(i.alias("start"), F.slice(records, i + 1, PIECE_RECORDS).alias("of"))
    )
    dealt = files.select(*held, F.explode_outer(pieces).alias("piece")).repartition(
        TASKS_PER_CORE * cores, "keys", "piece.start"
    )
    return dealt.select(*held, "piece.start", F.posexplode_outer("piece.of").alias("i", name)).select(
        *held, (F.col("start") + F.col("i")).alias("at"), name
    )


def _nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def _strict_json(text: Column) -> Column:
    """The text as the one element of a VARIANT array, or null where it is no JSON.

    The parser stops at the end of the first value, whatever follows. What follows a value breaks
    the brackets put around it, or the braces.
    """
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}")))
    return F.when(member.isNotNull(), array)


def _json_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    bare = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(bare, '"[^"]*+"', ""), r"[^\[\]{}]++", "")
    # Equal neighbours are as deep as one of them; records mostly come down to a few characters.
    for pair in ("{}", "{{}}", "{{{}}}"):
        around = r"[\[{]" * (len(pair) // 2) + r"[\]}]" * (len(pair) // 2)
        brackets = F.regexp_replace(brackets, f"(?:{around})++", pair)

    def step(at: Column, c: Column) -> Column:
        now = F.when(c.isin("[", "{"), at["now"] + 1).otherwise(F.greatest(at["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, step, lambda at: at["most"])


def truncate_text(df: DataFrame, col: str = "text", n: int = MAX_TEXT_CHARS) -> DataFrame:
    return df.withColumn(col, F.substring(col, 1, n))


def chunk_text(df: DataFrame, col: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """Cut a text into chunks; one regex pass, where substrings would rescan the text."""
    chunks = F.regexp_extract_all(F.col(col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(chunks).alias("chunk", col))


def tokens(text: Column) -> Column:
    """Tokens between blanks and line feeds, at least two characters long."""
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: F.length(t) >= MIN_TOKEN_CHARS)


def tokenize(df: DataFrame, col: str = "text", ids: Sequence[str] = ()) -> DataFrame:
    return df.select(*ids, F.posexplode(tokens(F.col(col))).alias("position", "token"))


def without_stopwords(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD_OR_PUNCTUATION), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))
    return F.array_join(kept, " ")


def remove_stopwords(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, without_stopwords(F.col(col)))


def normalize_token(token: Column) -> Column:
    return F.translate(F.lower(token), ".'-_,", "")


def combine_text(df: DataFrame, doc: str, pos: str, col: str) -> DataFrame:
    """One row per document: its fragments joined by blanks, in order.

    A document is one value, so it has to fit into a task, as every text elsewhere.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(col))))
    return df.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda f: f[col]), " ").alias(col)
    )
