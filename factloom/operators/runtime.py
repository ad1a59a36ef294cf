"""Runtime events: log lines to events, and an event's stack trace as a tree of throwables, each with
its frames, exploded once into event, anchor, throwable and frame rows.

Lines are fragments first: a trace that was flattened into one line is cut where a frame or a cause
begins, so that it gives the rows that the same trace in many lines gives.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import logs
from factloom.operators import query as q
from factloom.operators.graph import checkpointed

#: What the lines of a log look like.
STANDARD = r"^\[([^\]]+)\]\s+\[([^\]/\]]+)/(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\](?:\s+\[([^\]]+)\])?:?\s*(.*)$"
FLATTENED = r"\s+(Caused by:|Suppressed:|at\s+[A-Za-z_$][A-Za-z0-9_.$]*\.[A-Za-z_$][A-Za-z0-9_$<>]*)"
THROWN = r"^(?:.*?[\]:>]\s+)?([a-zA-Z_][\w.$]*(?:Exception|Error|Throwable))(?::\s*(.*))?\s*$"
CAUSED = r"^(?:.*?[\]:>]\s+)?Caused by:\s*([a-zA-Z_][\w.$]*(?:Exception|Error|Throwable))(?::\s*(.*))?\s*$"
SUPPRESSED = r"^\s*(?:.*?[\]:>]\s+)?Suppressed:\s*([a-zA-Z_][\w.$]*(?:Exception|Error|Throwable))(?::\s*(.*))?\s*$"
AT = r"^\s*(?:.*?[\]:>]\s+)?at\s+(.+?)\s*$"
MORE = r"^\s*\.\.\.\s+\d+\s+more\s*$"
CALL = r"^([A-Za-z_$][A-Za-z0-9_.$]*)\.([A-Za-z_$][A-Za-z0-9_$<>]*)\(([^():]+)?(?::(\d+))?\)$"
HEADER_ONLY = r"^[^\s:]*(Exception|Error|Throwable)(:|$)"
CONTINUES = r"^(at |Caused by:|Suppressed:|\.\.\..* more$)"
#: Path elements before a frame's class that name no module.
NO_MODULE = ("", "minecraft", "java.base", "MC-BOOTSTRAP", "TRANSFORMER")
#: What a text says, in lower case, when all went on, when a crash was written down, and when a loader gave up.
RECOVERED = ("done (", "server started", "minecraft started", "successfully loaded", "startup complete")
CRASH_REPORT = ("crash report has been saved", "preparing crash report", "---- minecraft crash report ----", "a fatal error has been detected by the java runtime")
ABORTED = ("loading errors encountered", "failed to start minecraft", "mod loading has failed", "could not execute entrypoint", "missing or unsupported mandatory dependencies")
TERMINAL = ("process-fatal", "loader-abort", "crash-report-root", "watchdog-termination", "server-stopped")
MESSAGE_CHARS = 1000


def fragments(lines: DataFrame) -> DataFrame:
    """(source, line_no, fragment, text, _n_lines) from (source, line_no, text): lines cut before
    frames and causes, in logs that name an exception or error at all, and how many lines a log has."""
    named = F.contains("text", F.lit("Exception")) | F.contains("text", F.lit("Error"))
    spoilt = lines.groupBy("source").agg(F.max(named).alias("named"), F.count(F.lit(1)).alias("_n_lines"))
    cut = F.split(F.regexp_replace("text", FLATTENED, "\u0001$1"), "\u0001")
    # Most lines have nothing to cut; what is cut is made once.
    some = F.when(F.col("named") & (F.col("text").rlike(FLATTENED) | F.contains("text", F.lit("\u0001"))), F.filter(cut, lambda x: x.rlike(r"\S")))
    rows = lines.join(spoilt, "source").select("source", "line_no", "text", "_n_lines", F.posexplode_outer(some).alias("_i", "_part"))
    return rows.select(
        "source", "line_no", F.coalesce("_i", F.lit(0)).alias("fragment"), F.regexp_replace(F.coalesce("_part", "text"), r"\s+$", "").alias("text"), "_n_lines"
    )


def numbered(lines: DataFrame, range_lines: int = logs.RANGE_LINES) -> DataFrame:
    """Fragments of lines with is_start and event, their event's number in the source from 1; blank
    ones end an event and belong to none. A header starts an event. Frames, causes and indented
    fragments continue one, an exception's name only after a header of ERROR or FATAL. All else, and
    whatever follows a blank one, starts an event."""
    rows = fragments(lines).withColumn("_t", F.regexp_replace("text", r"^\s+", ""))
    rows = rows.withColumns({"_blank": F.col("_t") == "", "_header": F.startswith("_t", F.lit("[")) & F.col("_t").rlike(STANDARD), "_goes_on": F.col("_t").rlike(CONTINUES) | F.col("text").rlike(r"^\s")})
    rows = rows.withColumn("_thrown", F.col("_t").rlike(HEADER_ONLY) & ~F.col("_header") & ~F.col("_goes_on"))
    level = F.regexp_extract(F.regexp_replace("text", r"^\s+", ""), STANDARD, 3)  # of headers alone
    rows = logs.scanned(rows.drop("_t"), ["line_no", "fragment"], level, True, range_lines)
    return rows.where("not _blank").select("source", "line_no", "fragment", "text", "is_start", "event")


def parsed(rows: DataFrame) -> DataFrame:
    """rows with what their line x is in a trace: its kind, whether it throws, what it throws, and a
    frame's module, class, method, file, line and whose code it is."""
    x = F.col("x")
    # What a pattern needs is looked for before it is tried.
    has = lambda *words: reduce(or_, [F.contains(x, F.lit(w)) for w in words])
    rows = rows.withColumns({
        "_ca": has("Caused by:") & x.rlike(CAUSED), "_th": has("Exception", "Error", "Throwable") & x.rlike(THROWN), "_su": has("Suppressed:") & x.rlike(SUPPRESSED),
        "_body": F.when(has("at"), F.regexp_extract(x, AT, 1)).otherwise(""),
    })
    kind = F.when(F.col("_body") != "", "frame").when(x.rlike(MORE), "more").when(F.col("_ca"), "cause").when(F.col("_su"), "suppressed").otherwise("other")
    part = lambda i: F.when(F.col("_ca"), F.regexp_extract(x, CAUSED, i)).when(F.col("_th"), F.regexp_extract(x, THROWN, i)).when(F.col("_su"), F.regexp_extract(x, SUPPRESSED, i))
    rows = rows.withColumns({
        "kind": kind, "throws": F.col("_ca") | F.col("_th"), "type": part(1), "thrown": F.nullif(F.trim(part(2)), F.lit("")),
        "_whole": F.regexp_replace(F.trim("_body"), "^(at )+", ""),
    })
    cut = F.when(F.contains("_whole", F.lit(" ~[")), F.substring_index("_whole", " ~[", 1)).otherwise(F.substring_index("_whole", " [", 1))
    rows = rows.withColumn("_symbol", cut).withColumn("_last", F.substring_index("_symbol", "/", -1))
    moduled = F.contains("_symbol", F.lit("/")) & F.contains("_last", F.lit("(")) & F.contains("_last", F.lit("."))
    module = F.substring_index(F.substring_index(F.regexp_extract("_symbol", r"^(.*)/[^/]*$", 1), "/", -1), "@", 1)
    rows = rows.withColumns({"_moduled": moduled, "_module": module})
    rows = rows.withColumn("_call", F.when(F.col("_moduled"), F.col("_last")).otherwise(F.col("_symbol"))).withColumn("_known", F.col("_call").rlike(CALL))
    piece = lambda i: F.when(F.col("_known"), F.nullif(F.regexp_extract("_call", CALL, i), F.lit("")))
    rows = rows.withColumns({
        "module": F.when(F.col("_moduled") & ~F.col("_module").isin(*NO_MODULE), F.col("_module")), "class": F.coalesce(piece(1), F.col("_whole")),
        "method": F.coalesce(piece(2), F.lit("")), "file": piece(3), "line": piece(4).cast("long"),
    }).withColumn("classification", logs.frame_kind(F.col("class")))
    return rows.drop("_ca", "_th", "_su", "_body", "_whole", "_symbol", "_last", "_moduled", "_module", "_call", "_known")


FRAME = ("module", "class", "method", "file", "line", "classification")
_EMPTY = "cast(array() as array<struct<index:int,type:string,message:string,cause:int,suppressed:boolean,deepest:boolean,frames:array<struct<module:string,class:string,method:string,file:string,line:bigint,classification:string>>>>)"


def chained(rows: DataFrame) -> DataFrame:
    """rows with chain, from _lines, an event's parsed lines in order: the first throwable of the first
    trace, its causes in order, then the suppressed ones; each with its frames, which cause follows it
    (-1: none) and whether it is the deepest that is not suppressed."""
    rows = rows.withColumn("_at", F.expr("cast(array_position(transform(_lines, x -> x.throws), true) as int)"))
    rows = rows.withColumn("_rest", F.expr("slice(_lines, _at + 1, if(_at > 0, size(_lines), 0))"))
    rows = rows.withColumn("_stop", F.expr("cast(array_position(transform(_rest, x -> x.kind = 'other'), true) as int)"))
    rows = rows.withColumn("_rest", F.expr("if(_stop > 0, slice(_rest, 1, _stop - 1), _rest)"))
    # Where the trace's throwables are: the first before the rest, the others in it.
    rows = rows.withColumn("_links", F.expr("concat(array(0), filter(transform(_rest, (x, i) -> if(x.kind in ('cause', 'suppressed'), i + 1, 0)), i -> i > 0))"))
    rows = rows.withColumn("_ends", F.expr("concat(slice(_links, 2, size(_links)), array(size(_rest) + 1))"))
    rows = rows.withColumn("_nodes", F.expr(
        "transform(_links, (a, i) -> struct(if(a = 0, get(_lines, _at - 1), get(_rest, a - 1)) as l, a > 0 and get(_rest, a - 1).kind = 'suppressed' as suppressed,"
        " transform(filter(slice(_rest, a + 1, _ends[i] - a - 1), x -> x.kind = 'frame'),"
        f" x -> struct({', '.join(f'x.{c} as {c}' for c in FRAME)})) as frames))"
    )).withColumn("_main", F.expr("filter(_nodes, x -> not x.suppressed)"))
    chain = F.expr(
        "transform(concat(_main, filter(_nodes, x -> x.suppressed)), (x, i) -> struct(i as index, x.l.type as type, x.l.thrown as message,"
        " if(i + 1 < size(_main), i + 1, -1) as cause, x.suppressed as suppressed, i = size(_main) - 1 as deepest, x.frames as frames))"
    )
    rows = rows.withColumn("chain", F.when(F.col("_at") > 0, chain).otherwise(F.expr(_EMPTY)))
    return rows.drop("_at", "_rest", "_stop", "_links", "_ends", "_nodes", "_main", "_lines")


def events(lines: DataFrame, range_lines: int = logs.RANGE_LINES) -> DataFrame:
    """One row for each event of each log: (source, event, line_no, fragment, timestamp, thread, level,
    logger, message, continuation, chain). An event's own lines are one row; logs are not."""
    rows = numbered(lines, range_lines).withColumn("_t", F.regexp_replace("text", r"^\s+", ""))
    rows = rows.withColumn("_standard", F.col("is_start") & F.col("_t").rlike(STANDARD))
    x = F.when(F.col("_standard"), F.regexp_extract("_t", STANDARD, 5)).otherwise(F.col("_t"))
    rows = parsed(rows.withColumn("x", x))
    lines_ = F.array_sort(F.collect_list(F.struct("line_no", "fragment", "x", "kind", "throws", "type", "thrown", *FRAME)))
    head = F.min(F.when(F.col("is_start"), F.struct("line_no", "fragment", F.when(F.col("_standard"), F.col("_t")).alias("header"))))
    rows = rows.groupBy("source", "event").agg(lines_.alias("_lines"), head.alias("_h"))
    group = lambda i: F.nullif(F.regexp_extract("_h.header", STANDARD, i), F.lit(""))
    rows = rows.select(
        "source", "event", "_h.line_no", "_h.fragment", group(1).alias("timestamp"), group(2).alias("thread"), group(3).alias("level"), group(4).alias("logger"),
        F.expr("get(_lines, 0).x").alias("message"), F.expr("transform(slice(_lines, 2, size(_lines)), l -> l.x)").alias("continuation"), "_lines",
    )
    return chained(rows)


def hexed(tag: Column | str, value: Column) -> Column:
    """A tagged field in hex: the tag's length in four bytes, the tag, the value's in eight, the value."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    size = lambda c, width: F.lpad(F.hex(F.octet_length(c).cast("long")), width, "0")
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(size(tag, 8), F.hex(tag), size(value, 16), F.hex(value))


def field(tag: Column | str, value: Column) -> Column:
    """A tagged field as bytes."""
    return F.unhex(hexed(tag, value))


def joined(parts: Column) -> Column:
    """An array of hex as one."""
    return F.array_join(parts, "")


def _name(*parts) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def semantic_fingerprint() -> Column:
    """Of an event: its trace in full, or its level, logger and lines."""
    frame = lambda n, f, i: F.concat(*[
        hexed(_name("throwable", n["index"], "frame", i, name), f[key]) for name, key in (("class", "class"), ("method", "method"), ("source", "file"), ("line", "line"))
    ])
    node = lambda n: F.concat(
        hexed(_name("throwable", n["index"], "type"), n["type"]), hexed(_name("throwable", n["index"], "message"), n["message"]),
        hexed(_name("throwable", n["index"], "cause"), F.when(n["cause"] >= 0, n["cause"])), hexed(_name("throwable", n["index"], "suppressed"), n["suppressed"]),
        joined(F.transform(n["frames"], lambda f, i: frame(n, f, i))),
    )
    lines = joined(F.transform("continuation", lambda x, i: hexed(_name("continuation", i), x)))
    plain = F.concat(hexed("level", F.col("level")), hexed("logger", F.col("logger")), hexed("message", F.col("message")), lines)
    body = F.when(F.size("chain") > 0, joined(F.transform("chain", node))).otherwise(plain)
    return F.sha2(F.unhex(F.concat(hexed("schema", F.lit("runtime-semantic-v1")), body)), 256)


def fuzzy_fingerprint() -> Column:
    """Of an event: the deepest throwable's simple name, its message without numbers, and its frames'
    classes and methods; or the event's own message without numbers."""
    frames = joined(F.transform(F.col("deepest")["frames"], lambda f, i: F.concat(hexed(_name("frame", i, "class"), f["class"]), hexed(_name("frame", i, "method"), f["method"]))))
    family = F.substring_index(F.col("deepest")["type"], ".", -1)
    thrown = F.concat(hexed("exception-family", family), hexed("normalized-message", logs.normalised(F.coalesce(F.col("deepest")["message"], F.lit("")))), frames)
    plain = hexed("message", logs.normalised(F.col("message")))
    return F.sha2(F.unhex(F.concat(hexed("schema", F.lit("runtime-fuzzy-v1")), F.when(F.size("chain") > 0, thrown).otherwise(plain))), 256)


def _says(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def described(rows: DataFrame) -> DataFrame:
    """events with deepest, the last throwable that is not suppressed, terminality, crash_relevance, relevance_score, both fingerprints and occurrence_id.
    Whether a log recovers or writes a crash report later is the place of the last such event."""
    text = F.lower(F.concat_ws("\n", F.array("message"), F.col("continuation")))
    rows = checkpointed(rows)  # parsed once for all that follows
    rows = rows.withColumn("deepest", F.get(F.filter("chain", lambda x: x["deepest"]), F.lit(0))).withColumn("_text", text).withColumns({"_ok": _says(F.col("_text"), RECOVERED), "_report": _says(F.col("_text"), CRASH_REPORT)})
    last = rows.groupBy("source").agg(F.max(F.when(F.col("_ok"), F.col("event"))).alias("_last_ok"), F.max(F.when(F.col("_report"), F.col("event"))).alias("_last_report"))
    rows = rows.join(last, "source")
    text, has = F.col("_text"), F.size("chain") > 0
    later = lambda c: F.coalesce(F.col(c) > F.col("event"), F.lit(False))
    says = lambda *m: _says(text, m)
    dog = says("watchdog") | F.contains(F.lower(F.coalesce("thread", F.lit(""))), F.lit("watchdog")) | F.contains(F.lower(F.coalesce("logger", F.lit(""))), F.lit("watchdog"))
    no_memory = F.exists("chain", lambda x: x["type"].endswith("OutOfMemoryError") | x["type"].endswith("VirtualMachineError"))
    failing = has | F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False))
    kind = (
        F.when(~failing, "unknown").when((says("update") & says("check")) | says("telemetry", "could not contact"), "background-error")
        .when(dog & (says("exception", "server hang", "single server tick") | has), "watchdog-termination").when(_says(text, ABORTED), "loader-abort")
        .when(F.col("_report") | later("_last_report"), "crash-report-root")
        .when(F.coalesce(F.col("level") == "FATAL", F.lit(False)) | no_memory | says("a fatal error has been detected by the java runtime environment"), "process-fatal")
        .when(later("_last_ok"), "recovered").otherwise("unknown")
    )
    rows = rows.withColumn("terminality", kind)
    terminal = F.col("terminality").isin(*TERMINAL)
    relevance = (
        F.when(has & terminal, "causal").when(has & (F.col("terminality") == "unknown"), "unknown")
        .when(F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False)) & ~F.col("terminality").isin("recovered", "background-error"), "contributing").otherwise("background")
    )
    score = F.when(F.col("crash_relevance") == "causal", 100).when(F.col("crash_relevance") == "contributing", 65).when(F.col("crash_relevance") == "unknown", 40).otherwise(15)
    rows = rows.withColumn("crash_relevance", relevance).withColumn("relevance_score", score)
    rows = rows.withColumns({"semantic_fingerprint": semantic_fingerprint(), "fuzzy_fingerprint": fuzzy_fingerprint()})
    place = F.sha2(field("source", F.replace("source", F.lit("\\"), F.lit("/"))), 256)
    occurrence = F.concat_ws(":", F.lit("runtime-event"), F.substring("semantic_fingerprint", 1, 16), F.substring(place, 1, 12), F.col("line_no").cast("string"), (F.col("event") - 1).cast("string"))
    return rows.withColumn("occurrence_id", occurrence).drop("_text", "_ok", "_report", "_last_ok", "_last_report")


def interesting(rows: DataFrame) -> DataFrame:
    """Events from warnings on, and those with a trace."""
    return rows.where(F.coalesce(F.col("level").isin("WARN", "ERROR", "FATAL"), F.lit(False)) | (F.size("chain") > 0))


def _common() -> list:
    return ["occurrence_id", "source", "line_no", "semantic_fingerprint", "fuzzy_fingerprint", F.col("fragment").alias("normalized_fragment")]


def runtime_events(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return interesting(rows).select(
        *_common(), blank("timestamp"), blank("thread"), F.coalesce("level", F.lit("UNKNOWN")).alias("level"), blank("logger"),
        F.substring("message", 1, MESSAGE_CHARS).alias("message"), F.size("continuation").alias("continuation_count"), "terminality", "crash_relevance", "relevance_score",
    )


def crash_anchors(rows: DataFrame) -> DataFrame:
    """Of events that ended the process."""
    ended = interesting(rows).where(F.col("terminality").isin(*TERMINAL))
    return ended.select(*_common(), F.col("terminality").alias("anchor_type"), F.coalesce(F.col("deepest")["type"], F.lit("")).alias("root_cause_exception"))


def throwable_nodes(rows: DataFrame) -> DataFrame:
    nodes = interesting(rows).select(*_common(), F.explode("chain").alias("n"))
    return nodes.select(*[c for c in nodes.columns if c != "n"], "n.index", "n.type", F.coalesce("n.message", F.lit("")).alias("message"), "n.cause", "n.deepest", "n.suppressed")


def stack_frames(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Frames with their owners: those of the longest package that holds the class, else the module
    if it is an owner. owners: (package, owner)."""
    nodes = interesting(rows).select(*_common(), F.explode("chain").alias("n"))
    frames = nodes.select(*[c for c in nodes.columns if c != "n"], F.col("n.index").alias("throwable_index"), F.posexplode("n.frames").alias("frame_index", "f"))
    frames = frames.select(*[c for c in frames.columns if c != "f"], "f.module", F.col("f.class").alias("class"), "f.method", "f.file", F.col("f.line").alias("source_line"), "f.classification")
    by_class = q.longest_prefix(frames.select("class").distinct(), owners, "class", "package", "owner").select("class", "owners")
    named = owners.select(F.col("owner").alias("module")).distinct().withColumn("is_owner", F.lit(True))
    out = frames.join(by_class, "class", "left").join(named, "module", "left")
    none = F.array().cast("array<string>")
    found = F.coalesce("owners", F.when(F.col("is_owner"), F.array("module")), none)
    out = out.withColumn("owners", found)
    n = F.size("owners")
    return out.select(
        *[c for c in nodes.columns if c != "n"], "throwable_index", "frame_index", "class", "method", F.coalesce("module", F.lit("")).alias("module"),
        F.coalesce("file", F.lit("")).alias("file"), F.coalesce("source_line", F.lit(-1)).alias("source_line"), "classification",
        F.when(n == 1, F.get("owners", F.lit(0))).otherwise("").alias("mod_id"), F.array_join("owners", ",").alias("owner_candidates"),
        F.when(n == 0, "unresolved").when(n == 1, "exclusive").otherwise("ambiguous").alias("ownership"),
    )


def incidents(rows: DataFrame, frames: DataFrame, range_lines: int = logs.RANGE_LINES) -> DataFrame:
    """One row for each fuzzy fingerprint of events that ended the process: (fuzzy, strict, first,
    n_occurrences, cause, cause_message, caller, callee, ambiguous, rationale, contributors,
    background_before, n_background). What names the incident is its first occurrence, by log and
    line: the code that it went from and to, of frames with one owner, the last listed being the
    caller of all and the first the one it reached; if no frame has one owner, the first that several
    share. background_before is the nearest earlier event of that log which ended nothing, and
    n_background how many such events all logs have. The cause is that of the first occurrence with
    a trace. rows: described events; frames: stack_frames of them."""
    known = interesting(rows).withColumn("_anchor", F.col("terminality").isin(*TERMINAL))
    near = logs.nearest_before(known, ["line_no", "fragment"], F.when(~F.col("_anchor"), F.col("occurrence_id")), "background_before", range_lines, "event")
    at = F.struct("source", "line_no", "fragment")
    traced = F.col("deepest").isNotNull()
    groups = near.where("_anchor").groupBy(F.col("fuzzy_fingerprint").alias("fuzzy")).agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.min_by("occurrence_id", at).alias("first"), F.min_by("semantic_fingerprint", at).alias("strict"),
        F.min_by("background_before", at).alias("background_before"), F.min_by(F.struct("deepest.type", "deepest.message"), F.when(traced, at)).alias("_cause"),
    )
    place = F.struct("throwable_index", "frame_index")
    owned, shared = F.col("mod_id") != "", F.col("ownership") == "ambiguous"
    method = F.struct(place.alias("place"), F.concat_ws(".", "class", "method").alias("method"))
    stacks = frames.join(groups.select(F.col("first").alias("occurrence_id")), "occurrence_id", "left_semi").groupBy(F.col("occurrence_id").alias("first")).agg(
        F.max_by(method, F.when(owned, place)).alias("_caller"), F.min_by(method, F.when(owned, place)).alias("_callee"),
        F.min_by(F.struct(method.alias("m"), "owner_candidates"), F.when(shared, place)).alias("_shared"),
        F.array_join(F.array_sort(F.collect_set(F.when(owned, F.col("mod_id")))), ",").alias("contributors"),
    )
    background = known.where("not _anchor").agg(F.count(F.lit(1)).alias("n_background"))
    out = groups.join(stacks, "first", "left").crossJoin(F.broadcast(background))  # one row
    moved = F.col("_callee").isNotNull()
    return out.select(
        "fuzzy", "strict", "first", "n_occurrences", F.col("_cause.type").alias("cause"), F.col("_cause.message").alias("cause_message"),
        F.when(moved & (F.col("_caller.place") != F.col("_callee.place")), F.col("_caller.method")).alias("caller"),
        F.when(moved, F.col("_callee.method")).otherwise(F.col("_shared.m.method")).alias("callee"),
        F.when(moved, False).when(F.col("_shared").isNotNull(), True).alias("ambiguous"),
        F.when(moved, "ordered runtime stack ownership transition").otherwise(F.concat(F.lit("runtime frame ownership is shared by "), F.col("_shared.owner_candidates"))).alias("rationale"),
        F.coalesce("contributors", F.lit("")).alias("contributors"), "background_before", "n_background",
    )
