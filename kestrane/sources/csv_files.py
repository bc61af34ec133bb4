"""Messy delimited files: sniffing, header union and all-text scans.

The driver reads only names and the first bytes of files, as streams of Spark's file systems,
so neither their kind nor a file's size matters; rows are read, cut and aligned on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import canonical_header, year_in_name
from ..scratch import hadoop_path

# Separators in the order in which they are tried.
SEPARATORS = (";", ",", "\t", "|", "~")
SAMPLE_BYTES, SAMPLE_ROWS = 65_536, 5
#: What Windows-1252 has in the place of Latin-1's second set of controls.
SIGNS = tuple("".join(bytes([b]).decode(e) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) for e in ("latin-1", "cp1252"))
# Labels of grades in names of columns and files.
GRADE_LABELS = ("2b", "4b", "6b", "8b", "2m")
# Byte order marks and their encodings.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def guess_encoding(head: bytes) -> str:
    """The encoding of the first bytes of a file.

    A byte order mark decides; then UTF-8 if they are valid, but for a cut last character;
    else Windows-1252 where a byte stands for a control in Latin-1 and for a sign there, or Latin-1.
    """
    for mark, encoding in MARKS:
        if head.startswith(mark):
            return encoding
    try:
        head.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data":
            return "utf-8"
    signs = [b for b in head if 0x80 <= b < 0xA0]
    return "windows-1252" if signs and not set(signs) & {0x81, 0x8D, 0x8F, 0x90, 0x9D} else "iso-8859-1"


def sniff_bytes(head: bytes, forced: str | None = None) -> tuple[str, str] | None:
    """(encoding, separator): the first separator with which the first rows have two columns or more.

    `forced` names the encoding. None for what is not text.
    """
    encoding = forced or guess_encoding(head)
    if not head or (b"\x00" in head and not encoding.lower().startswith("utf-16")):
        return None
    try:
        text = head.decode(encoding, "ignore" if encoding == "utf-8" else "strict")
    except UnicodeDecodeError:
        return None
    lines = [x for x in text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()][: SAMPLE_ROWS + 1]
    if any(ord(c) < 32 and c not in "\t" for x in lines for c in x):
        return None
    return next(((encoding, sep) for sep in SEPARATORS if lines and all(sep in x for x in lines)), None)


def listed(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length) of the files under a folder, in no order; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def first_bytes(spark: SparkSession, path: str, length: int) -> bytes:
    """The first SAMPLE_BYTES of a file, from a stream."""
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(length, SAMPLE_BYTES)))
    finally:
        stream.close()


#: Files whose first bytes are read at the same time.
AT_ONCE = 32


def headers(spark: SparkSession, folder: str, pattern: str = "*.csv", forced: str | None = None, only: Collection[str] | None = None) -> list[tuple[str, str, str, list[str]]]:
    """(path, encoding, separator, column names) of every readable file, in the order of their paths; `only`: paths to look at."""

    def told(r) -> tuple[str, str, str, list[str]] | None:
        head = first_bytes(spark, r.path, r.length)
        found = sniff_bytes(head, forced)
        if not found:
            return None
        encoding, sep = found
        first = head.decode(encoding, "replace").lstrip("\ufeff").replace("\r", "\n").split("\n")[0]
        return r.path, encoding, sep, distinct_names([x.strip().strip('"') for x in first.split(sep)])

    files = [r for r in listed(spark, folder, pattern).orderBy("path").toLocalIterator() if only is None or r.path in only]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x for x in pool.map(told, files) if x]


def distinct_names(names: Sequence[str]) -> list[str]:
    """Canonical names; blank ones by place, repeated ones numbered from two."""
    out: list[str] = []
    for i, raw in enumerate(names):
        name = canonical_header(raw) or f"col_{i}"
        n, unique = 1, name
        while unique in out:
            n += 1
            unique = f"{name}__{n}"
        out.append(unique)
    return out


def union_columns(found: Sequence[Sequence[str]], priority: Sequence[str] = (), mandatory: Sequence[str] = (), last: Sequence[str] = ("_source_file",)) -> list[str]:
    """All columns in a fixed order: priority ones that occur, mandatory ones, the others by name, and the last."""
    every = {c for columns in found for c in columns}
    head = [c for c in priority if c in every]
    head += [c for c in mandatory if c not in head]
    return [*head, *sorted(every.difference(head, last)), *last]


#: What is told of a row that was left out: why, and the row as it stands; null for all others.
REJECTED = ("_motivo", "_fila")


def read_text_rows(spark: SparkSession, path: str | list[str], encoding: str, sep: str, columns: Sequence[str], rejected: bool = False) -> DataFrame:
    """An all-text scan of files with one header: rows with too many cells are left out, short ones filled with nulls.

    The row as it stands is kept next to its cells, to count them. With `rejected`, the rows left
    out stay, marked by the REJECTED columns.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `__bad` string"
    read_as = "iso-8859-1" if encoding == "windows-1252" else encoding  # Spark has no other charset with one byte a character
    rows = spark.read.csv(path, schema=schema, sep=sep, encoding=read_as, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True, quote='"', escape='"',
                          lineSep="\n" if encoding.startswith("utf-16") else None)
    outside_quotes = F.regexp_replace(F.col("__bad"), '"[^"]*"', "")
    cells = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(sep), F.lit(""))) + 1
    source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_source_file")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("__folder")
    text = lambda c: F.translate(f"`{c}`", *SIGNS).alias(c) if encoding == "windows-1252" else F.col(f"`{c}`")
    long = F.col("__bad").isNotNull() & (cells > len(columns))
    if rejected:
        marks = [F.when(long, F.concat(cells.cast("string"), F.lit(f" cells, {len(columns)} columns"))).alias(REJECTED[0]), F.when(long, F.col("__bad")).alias(REJECTED[1])]
        return rows.select(*[text(c) for c in columns], source, folder, "__bad").select(*[f"`{c}`" for c in columns], "_source_file", "__folder", *marks)
    return rows.select(*[text(c) for c in columns], "__bad", source, folder).filter(~long).drop("__bad")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", priority: Sequence[str] = (), mandatory: Sequence[str] = ("agno",), aliases: dict[str, str] | None = None,
                transforms: dict[str, Callable[[Column], Column]] | None = None, forced: str | None = None, rejected: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """All files of a folder as one all-text table with the union of their columns.

    Files with the same encoding, separator and header are scanned together. Aliases rename
    columns, several of one name are coalesced in order; a missing year comes from the file's
    or the folder's name; nulls become empty text, as in a delimited file. `rejected` as in
    `read_text_rows`; `only`: the paths to read.
    """
    kinds: dict[tuple, list[str]] = {}
    for path, encoding, sep, columns in headers(spark, folder, pattern, forced, only):
        kinds.setdefault((encoding, sep, tuple(columns)), []).append(path)
    rename = aliases or {}
    order = union_columns([[rename.get(c, c) for c in k[2]] for k in kinds], priority, mandatory)
    out = None
    for (encoding, sep, columns), paths in kinds.items():
        rows = read_text_rows(spark, paths, encoding, sep, columns, rejected)
        cells: dict[str, list[Column]] = {}
        for c in columns:
            cells.setdefault(rename.get(c, c), []).append(F.nullif(F.col(f"`{c}`"), F.lit("")))
        if "agno" in order and "agno" not in cells:
            cells["agno"] = [year_in_name(F.col("_source_file"), F.col("__folder")).cast("string")]
        value = lambda c: F.coalesce(*cells[c]) if c in cells else F.lit(None).cast("string")  # noqa: B023, E731
        part = rows.select(*[(F.col("_source_file") if c == "_source_file" else F.coalesce((transforms or {}).get(c, lambda x: x)(value(c)), F.lit(""))).alias(c) for c in order], *(REJECTED if rejected else ()))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*order, *(REJECTED if rejected else ())]))


def load_folder(spark: SparkSession, folder: str, out: str, **how) -> tuple[DataFrame, DataFrame]:
    """All files of a folder as `read_folder` reads them, stored at `out`, and beside them the rows that were left out: (_source_file, _motivo, _fila).

    One scan writes both. Every line below a header that is not blank is in one of them.
    """
    rows = read_folder(spark, folder, rejected=True, **how)
    rows.withColumn("_rechazada", F.col(REJECTED[0]).isNotNull()).write.mode("overwrite").partitionBy("_rechazada").parquet(out)
    stored = spark.read.schema(rows.schema.add("_rechazada", "boolean")).parquet(out)
    return stored.filter("NOT _rechazada").drop("_rechazada", *REJECTED), stored.filter("_rechazada").select("_source_file", *REJECTED)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Cells trimmed; those of white space alone are null."""
    return df.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def without_empty_rows(df: DataFrame) -> DataFrame:
    """df without the rows that have no value in any column."""
    return df.dropna("all")


def grade_in_names(columns: Sequence[str], file: str) -> str | None:
    """The first grade label that a column name holds, else one that the file's name holds."""
    for name in (*columns, file):
        for label in GRADE_LABELS:
            if label in name.lower():
                return label
    return None


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or ValueError if a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_aligned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append rows as delimited text with these columns in this order: those df lacks, and nulls, are empty; others are left out."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns]
    df.select(*[x.alias(c) for x, c in zip(cells, columns)]).write.mode("append").csv(path, header=True, emptyValue="", escape='"')


def line_counts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, rows) of the files under a folder: lines below the header."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count("*") - 1).alias("rows"))


def line_count(spark: SparkSession, path: str) -> int:
    """Rows below the header."""
    return max(0, spark.read.text(path).count() - 1)
