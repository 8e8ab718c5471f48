"""Symbol sources over files and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import fnv1a


def hex_pairs(content: Column) -> Column:
    """The bytes of a binary column as two hex digits each."""
    return F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def bytes_stream(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, pos, symbol: each byte a symbol."""
    out = df.select(*keys, F.posexplode(hex_pairs(F.col(content))).alias("pos", "h"))
    return out.select(*keys, F.col("pos").cast("long").alias("pos"), F.conv("h", 16, 10).cast("long").alias("symbol"))


def byte_windows(df: DataFrame, keys: list[str], content: str, width: int, stride: int) -> DataFrame:
    """keys, pos, symbol: the FNV-1a hash of every stride-th window of so many bytes."""
    n = F.octet_length(content)
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1, F.lit(stride)))
    out = df.withColumn("_s", F.explode(starts)).select(*keys, (F.col("_s") - 1).cast("long").alias("pos"), F.substring(F.col(content), F.col("_s"), F.lit(width)).alias("_w"))
    return out.select(*keys, "pos", fnv1a(F.col("_w")).alias("symbol"))


CELLS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def conllu_sentences(spark: SparkSession, path: str) -> DataFrame:
    """path, sentence, tokens (pos and the ten cells of each) of tab-separated treebank files; comments, ranges and empty nodes are left out.

    Sentences are read whole, divided by lines that hold nothing but white space, so no order over a file is needed. Line
    ends may be either kind: records end at the blank line of the kind that is found first, and are divided again.
    """
    crlf = not spark.read.option("lineSep", "\n").text(path).filter(F.endswith("value", F.lit("\r"))).limit(1).isEmpty()
    records = spark.read.option("lineSep", "\n\r\n" if crlf else "\n\n").text(path).select(F.input_file_name().alias("path"), F.explode(F.split("value", r"\n[\x20\t\r]*(?:\n|$)")).alias("block"))
    blocks = records.filter(F.contains("block", F.lit("\t"))).select("path", F.monotonically_increasing_id().alias("sentence"), F.split("block", "\n").alias("lines"))
    lines = F.filter("lines", lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit("\t")))
    cells = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.split(F.when(F.endswith(x, F.lit("\r")), F.left(x, F.length(x) - 1)).otherwise(x), "\t").alias("c")))
    return blocks.select("path", "sentence", F.filter(cells, lambda t: (F.size(t["c"]) == len(CELLS)) & t["c"][0].rlike(r"^\d+$")).alias("tokens"))


def conllu_tokens(spark: SparkSession, path: str) -> DataFrame:
    """path, sentence, pos, id, form, lemma, upos, ... of conllu_sentences(), a row a token."""
    rows = conllu_sentences(spark, path).select("path", "sentence", F.inline("tokens"))
    return rows.select("path", "sentence", "pos", *[F.col("c")[k].alias(n) for k, n in enumerate(CELLS)])


FIELDS = {
    "form": [("form", True)], "lemma": [("lemma", True)], "upos": [("upos", False)], "feats": [("feats", False)], "deprel": [("deprel", False)],
    "upos_feats": [("upos", False), ("feats", False)], "upos_deprel": [("upos", False), ("deprel", False)], "lemma_upos": [("lemma", True), ("upos", False)],
}


def fold32(x: Column) -> Column:
    """Both halves of 64 bits XORed; 1 in place of 0."""
    y = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(y == 0, F.lit(1).cast("long")).otherwise(y)


def _window_hash(symbols: Column) -> Column:
    """The hash of the bytes of each symbol, the lowest first."""
    text = F.array_join(F.transform(symbols, lambda v: F.concat(*[F.substring(F.lpad(F.hex(v), 16, "0"), 15 - 2 * k, 2) for k in range(8)])), "")
    return fnv1a(F.unhex(text))


def treebank_symbols(tokens: DataFrame, field: str = "upos", window: int = 1, stride: int = 1, boundary: bool = False, bits: int = 32) -> DataFrame:
    """path, sentence, pos, symbol of conllu_tokens: hashes of a key of each token, or of `window` of them in a row.

    Every stride-th window of a sentence counts, from its first. Keys that are empty or `_` leave the sequence; with
    boundary a symbol of all ones (pos null) ends each sentence. bits 32 folds the hashes. Forms and lemmas are
    lower-cased. A sentence is one group, so windows are made within its row.
    """
    key = F.concat_ws("|", *[F.lower(c) if low else F.col(c) for c, low in FIELDS[field]])
    canonical = (lambda h: fold32(h)) if bits == 32 else (lambda h: F.when(h == 0, F.lit(1).cast("long")).otherwise(h))
    keyed = tokens.select("path", "sentence", "pos", key.alias("key")).filter("key <> '' AND key <> '_'")
    known = keyed.select("key").distinct().withColumn("symbol", canonical(fnv1a(F.col("key"))))  # each key is hashed once
    rows = keyed.join(known, "key").groupBy("path", "sentence").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("x"))
    rows = rows.select("path", "sentence", F.transform("x", lambda p: p["symbol"]).alias("s"))
    starts = F.when(F.size("s") >= window, F.sequence(F.lit(1), F.size("s") - (window - 1), F.lit(stride)))
    out = rows.select("path", "sentence", "s", F.posexplode(starts).alias("pos", "at"))
    if window == 1:
        out = out.select("path", "sentence", F.col("pos").cast("long").alias("pos"), F.get("s", F.col("at") - 1).alias("symbol"))
    else:
        out = out.select("path", "sentence", F.col("pos").cast("long").alias("pos"), canonical(_window_hash(F.slice("s", F.col("at"), F.lit(window)))).alias("symbol"))
    if boundary:
        ends = tokens.select("path", "sentence").distinct().select("path", "sentence", F.lit(None).cast("long").alias("pos"), F.lit(-1).cast("long").alias("symbol"))
        out = out.unionByName(ends)
    return out


def treebank_counts(sentences: DataFrame, field: str = "upos", window: int = 1, stride: int = 1, boundary: bool = False, bits: int = 32) -> DataFrame:
    """symbol, count of what treebank_symbols() makes of the tokens of conllu_sentences().

    Windows are made within a sentence's row and counted by their keys, so that only different ones move and are hashed.
    """
    key = lambda t: F.concat_ws("|", *[F.lower(t["c"][CELLS.index(c)]) if low else t["c"][CELLS.index(c)] for c, low in FIELDS[field]])
    keys = F.filter(F.transform("tokens", key), lambda k: (k != "") & (k != "_"))
    rows = sentences.filter(F.size("tokens") > 0).select(keys.alias("keys"))
    starts = F.when(F.size("keys") >= window, F.sequence(F.lit(0), F.size("keys") - window, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    at = rows.select("keys", F.explode(F.concat(starts, F.array(F.lit(-1))) if boundary else starts).alias("at"))
    # No cell has a tab; a boundary is null.
    said = F.when(F.col("at") >= 0, F.concat_ws("\t", *[F.get("keys", F.col("at") + k) for k in range(window)]))
    counted = at.select(said.alias("said")).groupBy("said").count().withColumn("own", F.split("said", "\t"))
    canonical = (lambda h: fold32(h)) if bits == 32 else (lambda h: F.when(h == 0, F.lit(1).cast("long")).otherwise(h))
    symbol = canonical(_window_hash(F.transform("own", lambda k: canonical(fnv1a(k)))) if window > 1 else fnv1a(F.col("said")))
    return counted.select(F.when(F.col("said").isNull(), F.lit(-1).cast("long")).otherwise(symbol).alias("symbol"), "count").groupBy("symbol").agg(F.sum("count").alias("count"))


#: Bases of a chunk of a long sequence.
CHUNK = 1 << 16


def chunked(df: DataFrame, keys: list[str], seq: str, chunk: int = CHUNK, overlap: int = 0) -> DataFrame:
    """keys, start, piece (binary): a column of one-byte letters cut at fixed lengths, each piece with the next `overlap` letters.

    Pieces of binary are copied out at once; a string would be scanned from its start for each.
    """
    n = F.octet_length(seq)
    cut = df.filter(n > 0).select(*keys, F.col(seq).cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))).alias("start"))
    return cut.select(*keys, F.col("start").cast("long").alias("start"), F.substring(F.col("_b"), F.col("start") + 1, F.lit(chunk + overlap)).alias("piece"))


def fasta_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq of sequence files: records divided by their headers, line ends dropped, upper case."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]*)", 1)
    return rows.select(head.alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def fasta_kmers(spark: SparkSession, path: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """chrom, pos, kmer, symbol of sequence files: a chromosome's pieces are dealt out, so its k-mers are many tasks' work."""
    pieces = chunked(fasta_chunks(spark, path).withColumn("seq", plain("seq")), ["chrom"], "seq", chunk, k - 1).repartition("chrom", "start")
    return _kmers_of(pieces, ["chrom"], k, chunk)


def plain(seq: str) -> Column:
    """One byte for each letter: what isn't a base is N."""
    return F.regexp_replace(F.col(seq), "[^ACGT]", "N")


def kmers(df: DataFrame, keys: list[str], seq: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """keys, pos, kmer, symbol (two bits a base: A 0, C 1, G 2, T 3) of every k-mer of plain bases, k up to 31.

    The time is in proportion to the sequence's length.
    """
    return _kmers_of(chunked(df.select(*keys, plain(seq).alias("_seq")), keys, "_seq", chunk, k - 1), keys, k, chunk)


def _kmers_of(pieces: DataFrame, keys: list[str], k: int, chunk: int) -> DataFrame:
    n = F.octet_length("piece")
    starts = F.when(n >= k, F.sequence(F.lit(1), F.least(n - k + 1, F.lit(chunk))))
    out = pieces.select(*keys, "start", "piece", F.explode(starts).alias("_s"))
    out = out.select(*keys, (F.col("start") + F.col("_s") - 1).alias("pos"), F.substring(F.col("piece"), F.col("_s"), F.lit(k)).cast("string").alias("kmer"))
    return out.filter(~F.contains("kmer", F.lit("N"))).withColumn("symbol", kmer_key(F.col("kmer")))


def kmer_key(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name of interval files, plain or gzipped; name is empty if there is none.

    Cells are divided by any white space and commas. Empty lines, comments and track and browser lines are left out, and so
    are rows without two whole numbers or with end <= start.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike("^(#|track|browser)"))
    rows = rows.select(F.filter(F.split("line", r"[\s,]+"), lambda x: x != "").alias("c")).filter(F.size("c") >= 3)
    number = lambda k: F.when(F.get("c", F.lit(k)).rlike(r"^[+-]?\d+$"), F.get("c", F.lit(k)).try_cast("long"))
    out = rows.select(F.col("c")[0].alias("chrom"), number(1).alias("start"), number(2).alias("end"), F.coalesce(F.get("c", F.lit(3)), F.lit("")).alias("name"))
    return out.filter(F.col("start").isNotNull() & (F.col("end") > F.col("start")))


def duplications(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """chrom, start, end, name, score, strand, other, fraction of dumps of segmental duplications (tab-separated, also gzipped).

    Columns stand at the places that the public table has. Short and commented lines are left out; a row without a name is
    named by its place; other is the other copy's place, fraction how much of both is equal (null if missing).
    """
    c = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\t").alias("c")).filter(F.size("c") >= 10)
    at = lambda k: F.get("c", F.lit(k))
    place = F.concat(at(1), F.lit(":"), at(2), F.lit("-"), at(3))
    out = c.select(at(1).alias("chrom"), at(2).try_cast("long").alias("start"), at(3).try_cast("long").alias("end"), F.when(at(4) == "", place).otherwise(at(4)).alias("name"), at(5).try_cast("long").alias("score"), at(6).alias("strand"), F.concat(at(7), F.lit(":"), at(8), F.lit("-"), at(9)).alias("other"), at(26).try_cast("double").alias("fraction"))
    return out if chrom is None else out.filter(F.col("chrom") == chrom)


def csv_symbols(spark: SparkSession, path: str, column: int, bins: int, delimiter: str = ",", header: bool = True, low: float | None = None, high: float | None = None) -> DataFrame:
    """path, at, symbol: one numeric column of delimited files as equal-width bins of [low, high], beyond it the outermost.

    Without a given range the column's own is used: one pass that leaves two numbers. Rows without the column or without a
    finite number there are dropped. Nothing is quoted. `at` rises along each file. A range without width has no symbols.
    """
    names = [f"c{k}" for k in range(column + 1)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", delimiter).option("header", header).option("quote", "").option("enforceSchema", True).csv(path)
    x = F.trim(names[-1]).try_cast("double")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    if low is None or high is None:
        found = rows.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
        low, high = (found["low"] if low is None else low), (found["high"] if high is None else high)
    if low is None or high is None or not high > low:
        return rows.limit(0).select("path", "at", F.lit(0).cast("long").alias("symbol"))
    b = F.floor((F.col("x") - F.lit(float(low))) * F.lit((bins - 1) / (float(high) - float(low))))
    return rows.select("path", "at", F.when(F.col("x") <= float(low), 0).when(F.col("x") >= float(high), bins - 1).otherwise(b).cast("long").alias("symbol"))


def repeat_annotations(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """chrom, start, end, name, score, strand, class, family, repeat of annotation dumps (tab-separated, also gzipped).

    Columns stand at the places that the public repeat-masker tables have; short and commented lines are left out.
    """
    c = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 13)
    at = lambda k: F.col("c")[k]
    out = c.select(at(5).alias("chrom"), at(6).try_cast("long").alias("start"), at(7).try_cast("long").alias("end"), F.concat_ws("|", at(10), at(11), at(12)).alias("name"), at(1).try_cast("long").alias("score"), at(9).alias("strand"), at(11).alias("class"), at(12).alias("family"), at(10).alias("repeat"))
    return out if chrom is None else out.filter(F.col("chrom") == chrom)


def read_manifest(spark: SparkSession, path: str, columns: tuple[str, ...] = ("name", "symbols", "grammar")) -> DataFrame:
    """The named columns of manifest files: comma or, where the header has none, semicolon; comments, empty lines, quotes
    and a byte order mark are tolerated, and column names in any case. Each file is one row until its lines are cut.
    """
    text = F.regexp_replace(F.decode(F.col("content"), "utf-8"), "^\ufeff", "")
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    files = read_binary(spark, path).select("path", lines.alias("lines")).filter(F.size("lines") > 1)
    plain_cell = lambda x: F.btrim(x, F.lit('" \t'))
    head = F.col("lines")[0]
    files = files.withColumn("by", F.when(~F.contains(head, F.lit(",")) & F.contains(head, F.lit(";")), ";").otherwise(","))
    files = files.withColumn("names", F.transform(F.split(head, F.col("by")), lambda x: F.lower(plain_cell(x))))
    rows = files.select("path", "names", F.posexplode(F.slice("lines", F.lit(2), F.size("lines") - 1)).alias("row", "line"), "by").withColumn("c", F.split("line", F.col("by")))
    cells = [F.coalesce(plain_cell(F.get("c", F.array_position("names", F.lit(n)).cast("int") - 1)), F.lit("")).alias(n) for n in columns]
    out = rows.select("path", F.col("row").cast("long").alias("row"), *cells)
    return out.filter(F.concat(*columns) != "")


PROFILE = "name string, domain string, intent string, mode string, targets array<string>, order array<string>, max_steps int"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """path, the fields of a profile, and error: what is wrong with it, null if nothing is."""
    p = spark.read.schema(PROFILE).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n, m = F.coalesce(F.size("targets"), F.lit(0)), F.coalesce(F.size("order"), F.lit(0))
    error = (
        F.when(empty("name") | empty("domain") | empty("intent") | empty("mode"), "profile requires name/domain/intent/mode")
        .when(~F.col("mode").isin("workflow", "command"), "profile mode must be workflow or command")
        .when(~n.between(1, 8) | (m > 8), "profile target/order count out of range")
        .when(~F.coalesce(F.col("max_steps").between(1, 32), F.lit(False)), "profile max_steps must be 1..32")
        .when(F.exists("targets", lambda x: F.coalesce(x, F.lit("")) == ""), "empty target in profile")
    )
    return p.withColumn("error", error)


#: A row of a motif table: rank, family, motif, weight, balance, support.
MOTIF_ROW = r"^\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*([ACGT]{6,40})\s*\|\s*([0-9]+)\s*\|\s*([0-9.Ee+-]+)\s*\|\s*([0-9.Ee+-]+)\s*\|"
#: A line about a scanned window.
WINDOW_ROW = r"signature_scan [^:\s]+:\s+(\S+)\s+base=\[(\d+),(\d+)\]\s+len=(\d+)\s+hits=(\d+)\s+rc=(\d+)\s+density=([0-9.Ee+-]+)\s+rc_balance=([0-9.Ee+-]+)\s+period=(\d+)\s+rate=([0-9.Ee+-]+)"


def _scraped(spark: SparkSession, path: str, pattern: str, columns: list[tuple[str, str]]) -> DataFrame:
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern)).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("path"))
    return lines.select("path", "at", *[F.regexp_extract("value", pattern, k).try_cast(kind).alias(name) for k, (name, kind) in enumerate(columns, 1)])


def log_motifs(spark: SparkSession, path: str) -> DataFrame:
    """path, rank, family, motif, weight, rc_balance, support of the motif tables in log files; the first row of each motif in a file counts."""
    rows = _scraped(spark, path, MOTIF_ROW, [("rank", "long"), ("family", "long"), ("motif", "string"), ("weight", "long"), ("rc_balance", "double"), ("support", "double")])
    rest = ["rank", "family", "weight", "rc_balance", "support"]
    return rows.groupBy("path", "motif").agg(F.min_by(F.struct(*rest), "at").alias("r")).select("path", "motif", "r.*")


def log_windows(spark: SparkSession, path: str) -> DataFrame:
    """path, label, base_start, base_end, length, hits, rc, density, rc_balance, period, rate of the scan lines in log files."""
    names = [("label", "string"), *((n, "long") for n in ("base_start", "base_end", "length", "hits", "rc")), ("density", "double"), ("rc_balance", "double"), ("period", "long"), ("rate", "double")]
    return _scraped(spark, path, WINDOW_ROW, names).drop("at")
