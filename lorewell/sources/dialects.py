"""Session transcripts in four dialects, as normalised message rows.

A reader gives physical lines (path, line_no, value), or whole documents; a dialect parser turns them into
(session_id, line_no, part, role, content, tool_name, tool_input, tool_output, ts). Parsing is built-in
JSON access on strings: no schema is inferred, and a line that is no JSON gives no message but counts as read.

A: lines ``{type, timestamp, cwd, isSidechain, message: {role, content}}`` with blocks of text and tools.
B: lines ``{type: session_meta | response_item, timestamp, payload}``.
C: one document ``{sessionId, messages: [{type, content, timestamp, toolCalls}]}``.
D: lines with a nested ``message`` or flat ``role`` and ``content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["session_id", "line_no", "part", "role", "content", "tool_name", "tool_input", "tool_output", "ts"]
KNOWN_ROLES = ("user", "assistant", "tool_use", "tool_result", "system")


# The names of files and folders of the dialects.
AGENT_FILES, ROOT_FILE, CHATS = "agent-", ".project_root", "chats"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _files(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """(path, value): whole files under several folders; a folder that does not exist has none."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, value string")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(there, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, value): the physical lines of all files under one or more folders, numbered from 0; agents' own files are skipped, a missing folder is empty."""
    files = _files(spark, [path] if isinstance(path, str) else path, pattern)
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith(AGENT_FILES))
    text = F.regexp_replace("value", r"\n\z", "")
    return files.select("path", F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    return _files(spark, [path], pattern)


def project_roots(spark: SparkSession, path: str) -> DataFrame:
    """(folder, root): what the root file of each project folder says, without white space around it; empty files give none.

    File sources pass over names that begin with a dot, so these one-line files, one a project, are opened like a
    listing, through the file system; sessions are not touched.
    """
    jvm, out = spark._jvm, []
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/{ROOT_FILE}")) or []:
        stream = files.open(found.getPath())
        try:
            root = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        if root:
            out.append((found.getPath().getParent().toString(), root))
    return spark.createDataFrame(out, "folder string, root string")


def session_of(path: Column) -> Column:
    """The file name without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl?\z", "")


def _j(value: Column | str, path: str) -> Column:
    return F.get_json_object(value, path)


def _array(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def _is(value: Column, mark: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(value), F.lit(mark)), F.lit(False))


def _text_blocks(content: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """The texts of the blocks of some kinds, one per line."""
    texts = F.transform(F.filter(_array(content), lambda b: _j(b, "$.type").isin(*kinds)), lambda b: _j(b, "$.text"))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")


def _part(role, content=None, tool_name=None, tool_input=None, tool_output=None) -> Column:
    null = F.lit(None).cast("string")
    vals = [F.lit(role) if isinstance(role, str) else role] + [null if v is None else v for v in (content, tool_name, tool_input, tool_output)]
    return F.struct(*[v.cast("string").alias(n) for n, v in zip(("role", "content", "tool_name", "tool_input", "tool_output"), vals, strict=True)])


def _exploded(df: DataFrame, parts: Column, ts: Column) -> DataFrame:
    rows = df.select("session_id", "line_no", ts.alias("ts"), F.posexplode(parts).alias("part", "m"))
    return rows.select("session_id", "line_no", "part", "m.*", "ts").select(*COLUMNS)


def parse_a(lines: DataFrame) -> DataFrame:
    """Dialect A. A user line gives one message; an assistant line its joined text first, then its tool blocks in order; side chains are dropped."""
    v = F.col("value")
    df = lines.withColumn("session_id", session_of(F.col("path"))).withColumn("type", _j(v, "$.type")).withColumn("content", _j(v, "$.message.content"))
    df = df.where("type in ('user', 'assistant')").where(F.coalesce(_j(v, "$.isSidechain"), F.lit("false")) != "true")
    body = F.when(_is(F.col("content"), "["), _text_blocks(F.col("content"))).otherwise(F.coalesce("content", F.lit("")))
    blocks = F.coalesce(F.when(_is(F.col("content"), "["), _array(F.col("content"))), F.expr("cast(array() as array<string>)"))
    tools = F.transform(
        F.filter(blocks, lambda b: _j(b, "$.type").isin("tool_use", "tool_result")),
        lambda b: F.when(_j(b, "$.type") == "tool_use", _part("tool_use", _j(b, "$.name"), _j(b, "$.name"), _j(b, "$.input"))).otherwise(_part("tool_result", F.lit(""), None, None, _j(b, "$.content"))),
    )
    text = F.when(body != "", F.array(_part("assistant", body))).otherwise(F.filter(F.array(_part("assistant", body)), lambda x: F.lit(False)))
    parts = F.when(F.col("type") == "user", F.filter(F.array(_part("user", body)), lambda x: x["content"] != "")).otherwise(F.concat(text, tools))
    return _exploded(df, parts, _j(v, "$.timestamp"))


def parse_b(lines: DataFrame) -> DataFrame:
    """Dialect B: messages, function calls and their outputs; other items and broken lines give nothing."""
    v = F.col("value")
    df = lines.withColumn("session_id", F.coalesce(F.nullif(F.regexp_extract("path", r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", 1), F.lit("")), session_of(F.col("path"))))
    df = df.where(_j(v, "$.type") == "response_item").withColumn("kind", _j(v, "$.payload.type")).withColumn("content", _j(v, "$.payload.content"))
    text = F.when(_is(F.col("content"), "["), _text_blocks(F.col("content"), ("text", "input_text", "output_text"))).when(_is(F.col("content"), "{"), _j("content", "$.text")).otherwise(F.col("content"))
    name = _j(v, "$.payload.name")
    part = (
        F.when(F.col("kind") == "message", _part(F.when(_j(v, "$.payload.role") == "user", "user").otherwise("assistant"), text))
        .when(F.col("kind") == "function_call", _part("tool_use", name, name, _j(v, "$.payload.arguments")))
        .when(F.col("kind") == "function_call_output", _part("tool_result", F.lit(""), None, None, _j(v, "$.payload.output")))
    )
    parts = F.filter(F.array(part), lambda x: x.isNotNull() & ((x["role"].isin("tool_use", "tool_result")) | (F.coalesce(x["content"], F.lit("")) != "")))
    return _exploded(df, parts, normal_time(_j(v, "$.timestamp")))


def parse_c(documents: DataFrame) -> DataFrame:
    """Dialect C: user and assistant entries of one document; names of tools are appended as lines; empty ones are dropped."""
    df = documents.select(F.coalesce(_j("value", "$.sessionId"), session_of(F.col("path"))).alias("session_id"), F.posexplode(_array(_j("value", "$.messages"))).alias("line_no", "value"))
    v = F.col("value")
    df = df.where(_j(v, "$.type").isin("user", "gemini")).withColumn("content", _j(v, "$.content"))
    text = F.when(_is(F.col("content"), "["), F.array_join(F.filter(F.transform(_array(F.col("content")), lambda b: _j(b, "$.text")), lambda t: t.isNotNull()), "\n")).otherwise(F.col("content"))
    calls = F.transform(F.coalesce(_array(_j(v, "$.toolCalls")), F.expr("cast(array() as array<string>)")), lambda c: F.concat(F.lit("[Tool: "), F.coalesce(_j(c, "$.name"), F.lit("")), F.lit("]")))
    whole = F.array_join(F.filter(F.concat(F.array(F.nullif(text, F.lit(""))), calls), lambda t: t.isNotNull()), "\n")
    parts = F.filter(F.array(_part(F.when(_j(v, "$.type") == "user", "user").otherwise("assistant"), whole)), lambda x: x["content"] != "")
    return _exploded(df, parts, normal_time(_j(v, "$.timestamp")))


def parse_d(lines: DataFrame) -> DataFrame:
    """Dialect D: nested or flat messages; an unknown role is the assistant; rows that open a session give nothing."""
    v = F.col("value")
    df = lines.withColumn("session_id", session_of(F.col("path"))).where(~F.coalesce(_j(v, "$.type"), F.lit("")).isin("session", "init"))
    role = F.coalesce(_j(v, "$.message.role"), _j(v, "$.role"))
    df = df.withColumn("role", role).withColumn("content", F.coalesce(_j(v, "$.message.content"), _j(v, "$.content"))).where("role is not null")
    text = F.when(_is(F.col("content"), "["), F.array_join(F.filter(F.transform(_array(F.col("content")), lambda b: F.coalesce(_j(b, "$.text"), F.when(~_is(b, "{"), b))), lambda t: t.isNotNull()), "\n")).otherwise(F.col("content"))
    parts = F.filter(F.array(_part(F.when(F.col("role").isin(*KNOWN_ROLES), F.col("role")).otherwise("assistant"), text)), lambda x: F.coalesce(x["content"], F.lit("")) != "")
    return _exploded(df, parts, normal_time(F.coalesce(_j(v, "$.timestamp"), _j(v, "$.ts"))))


def normal_time(value: Column) -> Column:
    """ISO texts stay; numbers are milliseconds if above 1e12, else seconds."""
    n = value.try_cast("double")
    ms = F.when(n > 1e12, n).otherwise(n * 1000).cast("long")
    return F.when(n.isNotNull(), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSX")).otherwise(value)


def _edges(lines: DataFrame, head: int, tail: int) -> DataFrame:
    """The first ``head`` and last ``tail`` lines of each file that are not blank, with the flags ``head`` and ``tail``.

    The bounds are two aggregates of line numbers, each partial result at most ``head`` or ``tail`` numbers long.
    """
    full = lines.where(F.trim("value") != "")
    runs = full.groupBy("path", F.floor(F.col("line_no") / 1024).alias("run")).agg(F.sort_array(F.collect_list("line_no")).alias("n"))
    few = runs.select("path", F.slice("n", 1, head).alias("first"), F.slice(F.reverse("n"), 1, tail).alias("last"))
    # Only runs at the ends of a file can hold its first or last lines; the others are cut by counting before and after.
    ends = few.select("path", F.explode(F.array_distinct(F.concat("first", "last"))).alias("line_no"))
    up, down = F.row_number().over(Window.partitionBy("path").orderBy("line_no")), F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no")))
    near = ends.select("path", "line_no", (up <= head).alias("head"), (down <= tail).alias("tail")).where("head or tail")
    return full.join(near, ["path", "line_no"])


def _first(value: Column, cond: Column) -> Column:
    return F.min_by(value, F.when(cond & value.isNotNull(), F.col("line_no")))


def _last(value: Column, cond: Column) -> Column:
    return F.max_by(value, F.when(cond & value.isNotNull(), F.col("line_no")))


META = ["path", "session_id", "started_at", "ended_at", "cwd", "title"]


def session_meta(lines: DataFrame) -> DataFrame:
    """(path, session_id, started_at, ended_at, cwd, title, line_count) of dialect A, from a file's first 10 and last 30 lines that are not blank.

    The title is the earliest custom one of the tail, else the last generated one of the head.
    """
    v = F.col("value")
    near = _edges(lines, 10, 30).select("path", "line_no", "head", "tail", _j(v, "$.timestamp").alias("ts"), _j(v, "$.cwd").alias("cwd"), _j(v, "$.type").alias("type"), _j(v, "$.title").alias("title"), _j(v, "$.customTitle").alias("custom"))
    head, tail, c = F.col("head"), F.col("tail"), F.col
    meta = near.groupBy("path").agg(
        _first(c("ts"), head).alias("started_at"), _last(c("ts"), tail).alias("ended_at"), _first(c("cwd"), head).alias("cwd"),
        F.coalesce(_first(c("custom"), tail & (c("type") == "custom-title")), _last(c("title"), head & (c("type") == "ai-title"))).alias("title"),
    )
    counts = lines.groupBy("path").agg((F.max("line_no") + 1).alias("line_count"))
    return meta.join(counts, "path").select("path", session_of(F.col("path")).alias("session_id"), "started_at", "ended_at", "cwd", "title", "line_count")


def session_meta_b(lines: DataFrame) -> DataFrame:
    """The same columns but ``line_count`` for dialect B; sessions of sub-agents and files without an id are left out.

    Id and folder come from the meta line, else the id from the file's name; the title is the start of the first user text.
    """
    v = F.col("value")
    near = _edges(lines, 10, 30).select("path", "line_no", "head", "tail", normal_time(_j(v, "$.timestamp")).alias("ts"), _j(v, "$.type").alias("type"), _j(v, "$.payload.id").alias("id"), _j(v, "$.payload.cwd").alias("cwd"), _j(v, "$.payload.source.subagent").alias("agent"), _j(v, "$.payload.type").alias("kind"), _j(v, "$.payload.role").alias("role"), _j(v, "$.payload.content").alias("content"))
    c, head = F.col, F.col("head")
    opened = head & (c("type") == "session_meta")
    asked = head & (c("type") == "response_item") & (c("kind") == "message") & (c("role") == "user")
    text = F.nullif(F.when(_is(c("content"), "["), _text_blocks(c("content"), ("text", "input_text", "output_text"))).otherwise(c("content")), F.lit(""))
    meta = near.groupBy("path").agg(
        _last(c("id"), opened).alias("id"), _last(c("cwd"), opened).alias("cwd"), F.coalesce(F.bool_or(opened & c("agent").isNotNull()), F.lit(False)).alias("agent"),
        _first(c("ts"), head).alias("started_at"), _last(c("ts"), c("tail")).alias("ended_at"), F.left(_first(text, asked), F.lit(80)).alias("title"),
    )
    named = F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", 0), F.lit(""))
    return meta.where("not agent").withColumn("session_id", F.coalesce("id", named)).where("session_id is not null").select(*META)


def session_meta_c(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for dialect C: one document per session, its working folder from the root file of its project folder (folder, root)."""
    v = F.col("value")
    asked = F.filter(F.coalesce(_array(_j(v, "$.messages")), F.expr("cast(array() as array<string>)")), lambda m: (_j(m, "$.type") == "user") & ~_is(_j(m, "$.content"), "[") & (F.trim(_j(m, "$.content")) != ""))
    df = documents.select(
        "path", F.regexp_extract("path", rf"\A(.*)/{CHATS}/[^/]+\z", 1).alias("folder"), _j(v, "$.sessionId").alias("session_id"), normal_time(_j(v, "$.startTime")).alias("started_at"),
        normal_time(_j(v, "$.lastUpdated")).alias("ended_at"), F.left(_j(F.get(asked, F.lit(0)), "$.content"), F.lit(80)).alias("title"),
    ).where("session_id is not null")
    # One file system names a folder with two or three slashes after its scheme.
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "file:/")
    return df.withColumn("folder", plain("folder")).join(roots.select(plain("folder").alias("folder"), F.col("root").alias("cwd")), "folder", "left").select(*META)


def session_meta_d(lines: DataFrame) -> DataFrame:
    """The same for dialect D, from the first 30 and last 10 lines; the id is the opening line's, else the file's name, the title its own, else the start of the first user text."""
    v = F.col("value")
    near = _edges(lines, 30, 10).select("path", "line_no", "head", "tail", normal_time(F.coalesce(_j(v, "$.timestamp"), _j(v, "$.ts"))).alias("ts"), _j(v, "$.type").alias("type"), F.coalesce(_j(v, "$.id"), _j(v, "$.sessionId")).alias("id"), F.coalesce(_j(v, "$.cwd"), _j(v, "$.directory")).alias("cwd"), _j(v, "$.title").alias("own"), _j(v, "$.message.role").alias("r1"), _j(v, "$.role").alias("r2"), _j(v, "$.message.content").alias("c1"), _j(v, "$.content").alias("c2"))
    c, head = F.col, F.col("head")
    opened = head & c("type").isin("session", "init")
    nested = F.coalesce(c("type") == "message", F.lit(False))
    content = F.when(nested, c("c1")).otherwise(c("c2"))
    text = F.nullif(F.when(_is(content, "["), _text_blocks(content)).otherwise(content), F.lit(""))
    meta = near.groupBy("path").agg(
        _last(c("id"), opened).alias("id"), _last(c("cwd"), opened).alias("cwd"), _last(F.nullif(c("own"), F.lit("")), opened).alias("own"),
        _first(c("ts"), head).alias("started_at"), _last(c("ts"), c("tail")).alias("ended_at"), F.left(_first(text, head & (F.when(nested, c("r1")).otherwise(c("r2")) == "user")), F.lit(80)).alias("asked"),
    )
    return meta.select("path", F.coalesce("id", session_of(F.col("path"))).alias("session_id"), "started_at", "ended_at", "cwd", F.coalesce("own", "asked").alias("title"))


def available(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(source, folder, available): the known sources and whether their folders are there."""
    return spark.createDataFrame([(k, p, exists(spark, p)) for k, p in sorted(folders.items())], "source string, folder string, available boolean")


def list_sessions(meta: DataFrame, project: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest sessions first. ``after`` is inclusive and passes rows without a start."""
    if project:
        meta = meta.where(F.col("cwd") == project)
    if after:
        meta = meta.where(F.col("started_at").isNull() | (F.col("started_at") >= after))
    meta = meta.orderBy(F.col("started_at").desc_nulls_last(), "session_id")
    return meta.limit(limit) if limit else meta


def detected_projects(meta: DataFrame) -> DataFrame:
    """(project, sessions): sessions per working folder, most first."""
    return meta.groupBy(F.coalesce("cwd", F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)).alias("project")).agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "project")
