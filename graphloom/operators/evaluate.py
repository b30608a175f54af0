"""Recorded sessions: clean-up, turns and tool calls, and their score against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import basename

MAX_CALLS, MAX_IMPLEMENT, MIN_IMPLEMENT, MIN_FILES = 10, 0.30, 0.05, 0.95
FILE_PATTERN = r"([\w/.-]+\.tsx?)\b"


def clean_log(text: Column) -> Column:
    """Without terminal control sequences; line ends become line feeds."""
    out = F.regexp_replace(text, "\x1b\\[[0-?]*[ -/]*[@-~]", "")
    out = F.regexp_replace(out, "\x1b\\][^\x07]*(\x07|\x1b\\\\)", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    return F.regexp_replace(out, "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def log_lines(sessions: DataFrame) -> DataFrame:
    """(session_id, pos, line) of sessions (session_id, text)."""
    return sessions.select("session_id", F.posexplode(F.split(clean_log(F.col("text")), "\n")).alias("pos", "line"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines with kind: prompt, open, close, header, box, answer or other."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(r"^\s*╭"), "open").when(line.rlike(r"^\s*╰"), "close").when(line.rlike(r"^\s*│\s*[✓✗]\s+\S+"), "header").when(line.rlike(r"^\s*│"), "box").when(line.rlike(r"^\s*>\s+\S"), "prompt").when(line.rlike(r"^\s*✦"), "answer").otherwise("other")
    )
    return lines.withColumn("kind", kind)


def last_content(segments: DataFrame, key: str, order: str, content: str, *by: str) -> DataFrame:
    """(by, key, first, content): one row for each key, where it first stood and what it said last."""
    return segments.groupBy(*by, key).agg(F.min(order).alias("first"), F.max_by(content, order).alias("content"))


def conversation(lines: DataFrame) -> DataFrame:
    """(session_id, first, kind, key, content): the boxes, prompts and answers of redrawn screens, each once, in order.

    A segment is a box, a prompt or an answer with the lines that follow it. Its key is the first
    line of a box (blanks folded, 160 characters), the prompt, or 80 characters of the answer.
    Boxes without a tool's header, spinners for instance, are left out.
    """
    kinds = line_kinds(lines)
    window = Window.partitionBy("session_id").orderBy("pos")
    begins = F.col("kind").isin("open", "prompt", "answer") | ((F.col("kind") == "other") & (F.lag("kind").over(window) == "close"))
    kinds = kinds.withColumn("segment", F.sum(begins.cast("int")).over(window))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "line")))
    segments = kinds.groupBy("session_id", "segment").agg(ordered.alias("rows"), F.min("pos").alias("pos"))
    opener = F.get("rows", F.lit(0))["kind"]
    shown = F.transform("rows", lambda r: r["line"])
    header = F.get(F.filter("rows", lambda r: r["kind"] == "header"), F.lit(0))["line"]
    kind = F.when(opener == "open", "box").when(opener == "prompt", "user").when(opener == "answer", "ai")
    key = (
        F.when(opener == "open", F.substring(F.regexp_replace(F.trim(header), r"\s+", " "), 1, 160))
        .when(opener == "prompt", F.trim(F.get(shown, F.lit(0))))
        .otherwise(F.substring(F.trim(F.get(shown, F.lit(0))), 1, 80))
    )
    segments = segments.where("size(rows) > 0").select("session_id", "pos", kind.alias("kind"), key.alias("key"), F.array_join(shown, "\n").alias("content")).where("kind is not null and key is not null")
    return last_content(segments, "key", "pos", "content", "session_id", "kind").select("session_id", "first", "kind", "key", "content")


def turn_ids(lines: DataFrame, starts: Column, by: str, order: str) -> DataFrame:
    """lines with turn, the number of lines that start one so far."""
    return lines.withColumn("turn", F.sum(starts.cast("int")).over(Window.partitionBy(by).orderBy(order)).cast("int"))


def parse_sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, calls) of lines (session_id, pos, line).

    turns: session_id, turn, query, answer. calls: session_id, turn, call, tool, status, args,
    result_lines. Lines before the first prompt belong to no turn.
    """
    kinds = turn_ids(line_kinds(lines), F.col("kind") == "prompt", "session_id", "pos").where("turn > 0")
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "answer", F.struct("pos", F.trim(F.regexp_replace("line", r"^\s*✦\s*", "")).alias("line")))))
    turns = kinds.groupBy("session_id", "turn").agg(
        F.min(F.when(F.col("kind") == "prompt", F.trim(F.regexp_replace("line", r"^\s*>\s+", "")))).alias("query"), F.array_join(F.transform(said, lambda r: r["line"]), "\n").alias("answer")
    )
    window = Window.partitionBy("session_id", "turn").orderBy("pos")
    boxed = kinds.withColumn("call", F.sum((F.col("kind") == "header").cast("int")).over(window).cast("int")).where("call > 0 and kind in ('header', 'box')")
    head = F.max(F.when(F.col("kind") == "header", F.col("line")))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "box", F.struct("pos", F.trim(F.regexp_replace("line", "^\\s*│|│\\s*$", "")).alias("line")))))
    calls = boxed.groupBy("session_id", "turn", "call").agg(head.alias("head"), F.transform(body, lambda r: r["line"]).alias("result_lines"))
    return turns, calls.select(
        "session_id",
        "turn",
        "call",
        F.regexp_extract("head", r"│\s*[✓✗]\s+(\S+)", 1).alias("tool"),
        F.when(F.contains("head", F.lit("✓")), "✓").otherwise("✗").alias("status"),
        F.from_json(F.regexp_extract("head", r"(\{.*\})", 1), "map<string,string>").alias("args"),
        "result_lines",
    )


def call_share(calls: DataFrame, tool: str, by: str = "session_id", ok: Column | None = None) -> DataFrame:
    """(by, calls, share, too_many, over, under): successful calls, the tool's share, and whether the limits are broken."""
    good = calls.where(F.col("status") == "✓" if ok is None else ok)
    rates = good.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.avg((F.col("tool") == tool).cast("double")).alias("share"))
    return rates.withColumns({"too_many": F.col("calls") > MAX_CALLS, "over": F.col("share") > MAX_IMPLEMENT, "under": F.col("share") < MIN_IMPLEMENT})


def match_cases(turns: DataFrame, cases: DataFrame) -> DataFrame:
    """turns with the first case of exactly their question; others are ignored."""
    first = cases.withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("id"))).where("__n = 1").drop("__n")
    return turns.join(first, turns["query"] == first["question"])


def term_coverage(answers: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, found, total, coverage, flagged): how many of a key's terms (key, term) its answer (key, answer) holds; keys without terms have no row."""
    hit = terms.join(answers, key, "left").select(key, F.coalesce(F.contains("answer", "term"), F.lit(False)).alias("hit"))
    found, total = F.sum(F.col("hit").cast("bigint")), F.count(F.lit(1))
    return hit.groupBy(key).agg(found.alias("found"), total.alias("total"), (found / total).alias("coverage")).withColumn("flagged", F.col("coverage") < 1)


def file_hits(truth: DataFrame, implemented: DataFrame, graphed: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, file, source): where each truth file (key, file) was found: implement, graph or ai, in that order, by its base name."""
    base = truth.select(key, "file", basename(F.col("file")).alias("base"))

    def seen(rows: DataFrame, text: str, name: str) -> DataFrame:
        named = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        hit = base.join(named, (F.col(key) == F.col("__key")) & F.contains("__text", "base")).select(key, "file").distinct()
        return hit.withColumn(name, F.lit(name))

    out = base.join(seen(implemented, "file", "implement"), [key, "file"], "left").join(seen(graphed, "path", "graph"), [key, "file"], "left").join(seen(answers, "answer", "ai"), [key, "file"], "left")
    return out.select(key, "file", F.coalesce("implement", "graph", "ai").alias("source"))


def paths_in(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with path: every source path that a line names."""
    return lines.withColumn("path", F.explode(F.regexp_extract_all(F.col(line), F.lit(FILE_PATTERN), F.lit(1))))


def retrieval_positions(truth: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """(key, ord, file, position): the first place (from 1) in retrieved (key, pos, name) whose name holds the file's base name, else null."""
    base = truth.select(key, "ord", "file", basename(F.col("file")).alias("base"))
    names = retrieved.select(F.col(key).alias("__key"), "pos", F.col("name").alias("__name"))
    joined = base.join(names, (F.col(key) == F.col("__key")) & F.contains("__name", "base"), "left")
    return joined.groupBy(key, "ord", "file").agg((F.min("pos") + 1).alias("position"))


def order_alignment(positions: DataFrame, key: str) -> DataFrame:
    """(key, rank, expected, actual): truth files as expected and as retrieved, zipped by rank; files that were not retrieved come last."""
    by = Window.partitionBy(key)
    expected = positions.select(key, F.row_number().over(by.orderBy("ord")).alias("rank"), F.col("file").alias("expected"))
    actual = positions.select(key, F.row_number().over(by.orderBy(F.asc_nulls_last("position"), "ord")).alias("rank"), F.col("file").alias("actual"))
    return expected.join(actual, [key, "rank"], "full")


def error_counts(errors: DataFrame) -> DataFrame:
    """(type, n) of errors (type, ...)."""
    return errors.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def report_totals(coverage: DataFrame, hits: DataFrame) -> DataFrame:
    """(symbols_found, symbols, files_found, files, files_ok, all_files): totals of both tables; files_ok from 95 % on."""
    symbols = coverage.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("symbols_found"), F.coalesce(F.sum("total"), F.lit(0)).alias("symbols"))
    files = hits.agg(F.count("source").alias("files_found"), F.count(F.lit(1)).alias("files"))
    return symbols.crossJoin(files).withColumns({"files_ok": F.col("files_found") >= MIN_FILES * F.col("files"), "all_files": F.col("files_found") == F.col("files")})


def summary_box(lines: DataFrame, marker: str) -> DataFrame:
    """(session_id, pos, line): the lines of the nearest box around the last line that holds the marker."""
    kinds = line_kinds(lines)
    mark = kinds.where(F.contains("line", F.lit(marker))).groupBy("session_id").agg(F.max("pos").alias("mark"))
    near = kinds.join(mark, "session_id")
    edge = near.groupBy("session_id").agg(F.max(F.when((F.col("kind") == "open") & (F.col("pos") <= F.col("mark")), F.col("pos"))).alias("a"), F.min(F.when((F.col("kind") == "close") & (F.col("pos") >= F.col("mark")), F.col("pos"))).alias("b"))
    return kinds.join(edge, "session_id").where("pos between a and b").select("session_id", "pos", "line")


def newest_only(runs: DataFrame, by: str, ts: str) -> DataFrame:
    """The newest row of each kind."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))).where("__n = 1").drop("__n")
