"""Logs: lines to events, signals, fingerprints, exception chains, ownership and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed

#: Signals, how bad each is, and the pattern that an event's text has.
SIGNALS = (
    ("MixinApplyError", "error", r"(?i)(InvalidMixinException|Mixin apply failed|mixin transformation .* failed)"),
    ("NoClassDefFound", "error", r"NoClassDefFoundError"),
    ("ClassNotFound", "error", r"ClassNotFoundException"),
    ("MissingDependency", "error", r"(?i)(requires .* which is missing|Missing or unsupported mandatory dependencies|requires version)"),
    ("ModLoadingFailure", "error", r"(?i)(Failed to load mod\b|ModResolutionException|Could not execute entrypoint)"),
    ("OutOfMemory", "fatal", r"OutOfMemoryError"),
    ("StackOverflow", "error", r"StackOverflowError"),
    ("JvmCrash", "fatal", r"(A fatal error has been detected by the Java Runtime|SIGSEGV|EXCEPTION_ACCESS_VIOLATION)"),
    ("PortInUse", "error", r"(?i)(Address already in use|FAILED TO BIND TO PORT)"),
    ("DatapackValidationError", "warn", r"(?i)(Couldn't load .* datapack|Failed to load datapacks|Error while loading data pack)"),
    ("RegistryFreezeError", "error", r"(?i)(Registry is already frozen|Trying to access unbound|registry freeze)"),
    ("SodiumConflict", "error", r"(?i)(Sodium has already been installed|duplicate Sodium|Rubidium is installed|Embeddium.*Sodium)"),
    ("IrisShaderError", "error", r"(?i)(Iris.*Sodium|Sodium is required for Iris|shader pack failed|Iris encountered an error)"),
    ("LithiumConflict", "warn", r"(?i)(Lithium|CaffeineConfig|Radium).*(mixin|conflict|incompatible)"),
    ("CreateError", "error", r"(?i)(Unable to launch Create|Flywheel.*(error|exception)|(?:Create|Registrate|contraption).*(failed|exception))"),
    ("NeoForgeLoadError", "error", r"(?i)(ModLoadingException|Loading errors encountered|Failed to create mod instance)"),
    ("ResourceModelFailure", "warn", r"(?i)(Failed to load model\b|Unable to bake model\b)"),
    ("ResourceBlockstateFailure", "warn", r"(?i)(Failed to load blockstate\b|Exception loading blockstate\b)"),
    ("NativeWindowError", "error", r"(?i)(GLFW error|GL error off-thread|OpenGL error)"),
)
#: Of several signals the one of the highest rank stays, 50 where none is given.
SPECIFICITY = {
    "OutOfMemory": 100, "JvmCrash": 100, "MixinApplyError": 90, "NativeWindowError": 90, "ResourceModelFailure": 80, "ResourceBlockstateFailure": 80,
    "NeoForgeLoadError": 70, "ModLoadingFailure": 70, "ClassNotFound": 60, "NoClassDefFound": 60,
}
#: Failure categories with their patterns, the most telling first.
CATEGORIES = (
    ("mixin-apply-error", r"(?i)(InvalidMixinException|MixinTransformerError|Mixin apply failed|mixin transformation .* failed)"),
    ("performance-regression", r"(?i)(Can't keep up|can.t keep up|Running \d+ms behind|MSPT|server overloaded|tick took \d+)"),
    ("missing-dependency", r"(?i)(requires .* which is missing|Missing or unsupported mandatory dependencies|requires version)"),
    ("mod-loading-failure", r"(?i)(Failed to load mod|ModResolutionException|Could not execute entrypoint)"),
    ("class-not-found", r"(NoClassDefFoundError|ClassNotFoundException)"),
    ("registry-freeze-error", r"(?i)(Registry is already frozen|Trying to access unbound|registry freeze)"),
    ("datapack-validation-error", r"(?i)(Couldn't load .* datapack|Failed to load datapacks|Error while loading data pack)"),
    ("port-in-use", r"(?i)(Address already in use|FAILED TO BIND TO PORT)"),
    ("out-of-memory", r"OutOfMemoryError"),
    ("stack-overflow", r"StackOverflowError"),
    ("jvm-crash", r"(A fatal error has been detected by the Java Runtime|SIGSEGV|EXCEPTION_ACCESS_VIOLATION)"),
)
#: Whom a line of a category names, and in which group of the pattern.
SUBJECTS = (
    ("mixin-apply-error", r"(?i)(?:InvalidMixinException|Mixin apply failed|mixin transformation).*?(net\.[a-zA-Z0-9_$.]+)", 1),
    ("mixin-apply-error", r"(?i)@Mixin.*?target.*?([a-z][a-zA-Z0-9_/$.]+)", 1),
    ("mixin-apply-error", "(?i)Mod\\s+[\u201e\u201c\"']?([^\u201e\u201c\"'\\s:]+).*InvalidMixinException", 1),
    ("missing-dependency", r"(?i)Mod\s+([a-zA-Z0-9_-]+)\s+requires\s+([a-zA-Z0-9_-]+)", 1),
    ("mod-loading-failure", r"(?i)Failed to load mod\s+([a-zA-Z0-9_-]+)", 1),
    ("mod-loading-failure", r"(?i)Could not execute entrypoint.*?\b([a-zA-Z0-9_-]+)\b", 1),
    ("class-not-found", r"(?:NoClassDefFoundError|ClassNotFoundException):\s*([a-zA-Z0-9_$/]+)", 1),
    ("registry-freeze-error", r"(?i)(Registry is already frozen|Trying to access unbound).*?([a-z][a-zA-Z0-9_/$.]+)", 2),
    ("performance-regression", r"(?i)(?:MSPT|tick).*?(net\.[a-zA-Z0-9_$.]+)", 1),
    ("performance-regression", r"(?i)mod\s+([a-zA-Z0-9_-]+).*(?:can't keep up|can.t keep up|mspt)", 1),
)
#: What a script engine's line says is gone: engine, kind, how, and the id's pattern.
REMOVALS = (
    ("crafttweaker", "item", "recipe-output-removed", r"(?i)removing all recipes\b[^<]*<item:([a-z0-9_.-]+:[a-z0-9_./-]+)>"),
    ("crafttweaker", "item", "item-removed", r"(?i)(?:hiding|removing) item\b[^<]*<item:([a-z0-9_.-]+:[a-z0-9_./-]+)>"),
    ("crafttweaker", "recipe", "recipe-removed", r"(?i)removing recipe\b[^a-z0-9]*(?:<?recipe:)?([a-z0-9_.-]+:[a-z0-9_./-]+)>?"),
    ("crafttweaker", "tag", "tag-removed", r"(?i)(?:removing|clearing)\b[^<]*<tag:([a-z0-9_.-]+:[a-z0-9_./-]+)>"),
    ("crafttweaker", "loot_table", "loot-table-removed", r"(?i)(?:removing|replacing)\b[^<]*<loot_table:([a-z0-9_.-]+:[a-z0-9_./-]+)>"),
    ("groovyscript", "recipe", "recipe-removed", r"""(?i)\[groovyscript\][^\n]*?\brecipe\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("kubejs", "recipe", "recipe-removed", r"""(?i)remov(?:e|ed|ing)\b[^\n]*?\brecipe\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("kubejs", "item", "item-removed", r"""(?i)remov(?:e|ed|ing)\b[^\n]*?\bitem\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("kubejs", "tag", "tag-removed", r"""(?i)(?:remov(?:e|ed|ing)|clear(?:ed|ing)?)\b[^\n]*?\btag\b[^\n]*?['"](#?[a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("kubejs", "loot_table", "loot-table-removed", r"""(?i)remov(?:e|ed|ing)\b[^\n]*?\bloot(?:\s*table)?\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("groovyscript", "item", "item-removed", r"""(?i)remov(?:e|ed|ing)\b[^\n]*?\bitem\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("groovyscript", "tag", "tag-removed", r"""(?i)(?:remov(?:e|ed|ing)|clear(?:ed|ing)?)\b[^\n]*?\btag\b[^\n]*?['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("rhino", "recipe", "recipe-removed", r"""(?i)remov(?:e|ed|ing)\s+recipe\s+['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
    ("rhino", "item", "item-removed", r"""(?i)remov(?:e|ed|ing)\s+item\s+['"]([a-z0-9_.-]+:[a-z0-9_./-]+)['"]"""),
)
HEADER = r"^\[[^\]]*\] ?\[[^\]/]*/(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\]"
CONTINUED = r"^(\s+|\tat |at |Caused by:|Suppressed:|\.\.\. \d+ more)"
EXCEPTION = r"^([A-Za-z_$][\w$]*(?:\.[\w$]+)*(?:Exception|Error|Throwable))(?::\s*(.*))?$"
FRAME = r"at ([\w$.]+)\.([\w$<>]+)\(([^)]*)\)"


#: Lines of a log that one task scans together; what goes from range to range is a row for each.
RANGE_LINES = 1 << 16


def scanned(rows: DataFrame, order: list[str], level: Column, after_nothing: bool, range_lines: int = RANGE_LINES) -> DataFrame:
    """rows with is_start, event, its number in the source, and level: that of a header, empty for
    another row that surely starts an event. rows: source, line_no, what order names, and the flags
    _blank, _header, _goes_on and _thrown, of which one holds at most. A header starts an event, so
    does a row with no flag, and any row after a blank one, or, if after_nothing, at the log's
    begin; _goes_on continues one, and _thrown one whose level is ERROR or FATAL.

    A log is no window: ranges of its lines are scanned alone, leaving open what only earlier ranges
    can tell; a row for each range, its last, says what it hands on; those rows are scanned, and what
    comes in is put into the ranges. The ranges' own rows are stored, so they are made and sorted once.
    rows may have _n_lines, how many lines their log has: one of no more than a range's is one range,
    however its lines are numbered."""
    by_number = F.expr(f"line_no div {range_lines}")
    rows = rows.withColumn("_range", F.when(F.col("_n_lines") <= range_lines, 0).otherwise(by_number) if "_n_lines" in rows.columns else by_number)
    # So many parts as the session asks for: lines take little room and much work, and few would be made by their size.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "_range")
    here = W.partitionBy("source", "_range").orderBy(*order)
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_after": F.lag("_blank").over(here), "_end": F.lead("line_no").over(here).isNull()})  # _after null: an earlier range tells
    plain = ~F.col("_header") & ~F.col("_goes_on") & ~F.col("_thrown")
    rows = rows.withColumn("_sure", ~F.col("_blank") & (F.col("_header") | plain | F.coalesce("_after", F.lit(False))))
    rows = rows.withColumn("_open", F.col("_after").isNull() & ~F.col("_sure") & ~F.col("_blank"))
    rows = rows.withColumn("_level", F.when(F.col("_sure"), F.when(F.col("_header"), level).otherwise("")))
    rows = rows.withColumn("_near", F.last("_level", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1)))
    thrown = F.col("_thrown") & ~F.col("_sure")
    rows = rows.withColumn("_starts", F.col("_sure") | (thrown & F.coalesce(~F.col("_near").isin("ERROR", "FATAL"), F.lit(False))))
    rows = rows.withColumn("_pending", thrown & F.col("_near").isNull())  # starts one unless the level that comes in fails
    count = lambda c: F.coalesce(F.count_if(c).over(so_far), F.lit(0))
    rows = rows.withColumns({
        "_n": F.sum(F.col("_starts").cast("int")).over(so_far), "_waiting": count(F.col("_pending") & ~F.col("_open")), "_first": count(F.col("_pending") & F.col("_open")), "_opened": count(F.col("_open")),
    })
    rows = checkpointed(rows.drop("_after", "_sure", "_goes_on", "_header", "_thrown", "_n_lines"))
    sums = rows.where("_end").select(
        "source", "_range", F.col("_blank").alias("blank"), F.coalesce("_level", "_near").alias("level"), (F.col("_opened") > 0).alias("open"),
        F.coalesce("_n", F.lit(0)).alias("n"), F.col("_waiting").alias("waiting"), F.col("_first").alias("first"),
    )
    ranges = W.partitionBy("source").orderBy("_range")
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_starts_first", F.col("open") & F.coalesce(F.lag("blank").over(ranges), F.lit(after_nothing)))
    sums = sums.withColumn("_handed", F.coalesce("level", F.when(F.col("_starts_first"), "")))
    sums = sums.withColumn("_came_fails", F.coalesce(F.last("_handed", ignorenulls=True).over(before).isin("ERROR", "FATAL"), F.lit(False)))
    waiting = F.when(F.col("_starts_first"), F.col("waiting") + 1).when(F.col("_came_fails"), 0).otherwise(F.col("waiting") + F.col("first"))
    sums = sums.withColumn("_before", F.coalesce(F.sum(F.col("n") + waiting).over(before), F.lit(0)))
    rows = rows.join(sums.select("source", "_range", "_starts_first", "_came_fails", "_before"), ["source", "_range"])
    first = F.col("_open") & F.col("_starts_first")
    rows = rows.withColumn("is_start", F.col("_starts") | first | (F.col("_pending") & (F.col("_starts_first") | ~F.col("_came_fails"))))
    rows = rows.withColumn("level", F.when(first, "").otherwise(F.col("_level")))
    more = F.when(F.col("_starts_first"), F.col("_waiting") + F.col("_opened")).when(F.col("_came_fails"), 0).otherwise(F.col("_waiting") + F.col("_first"))
    rows = rows.withColumn("event", F.col("_before") + F.col("_n") + more)
    return rows.drop("_range", "_end", "_open", "_level", "_near", "_starts", "_pending", "_n", "_waiting", "_first", "_opened", "_starts_first", "_came_fails", "_before")


def nearest_before(rows: DataFrame, order: list[str], value: Column, name: str, range_lines: int = RANGE_LINES, number: str = "line_no") -> DataFrame:
    """rows of logs with the value of the nearest earlier row of the log that has one, as an as-of
    join would give it: within ranges of the rows' numbers, which go by the order, and from the last
    range that has one."""
    rows = rows.withColumn("_v", value).withColumn("_range", F.expr(f"{number} div {range_lines}"))
    ends = rows.groupBy("source", "_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("source", "_range", F.last("_end", ignorenulls=True).over(before).alias("_came"))
    here = W.partitionBy("source", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.last("_v", ignorenulls=True).over(here)).join(ends, ["source", "_range"])
    return rows.withColumn(name, F.coalesce("_here", "_came")).drop("_v", "_range", "_here", "_came")


def assembled(lines: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """lines: (source, line_no, text). Adds level, is_start and event: its number within the
    source. A header starts an event; frames and causes continue it; an exception header continues
    only after an error; any other line, and whatever follows a blank line, starts one."""
    text = F.col("text")
    rows = lines.withColumns({"_header": text.rlike(HEADER), "_goes_on": text.rlike(CONTINUED), "_thrown": text.rlike(EXCEPTION), "_blank": F.trim("text") == ""})
    rows = scanned(rows, ["line_no"], F.regexp_extract("text", HEADER, 1), False, range_lines)
    return rows.drop("_blank")


#: Signals in the order in which one is taken: by rank, of equal ranks the later one.
BY_RANK = tuple(sorted(SIGNALS, key=lambda s: (SPECIFICITY.get(s[0], 50), SIGNALS.index(s)), reverse=True))


def signal(text: Column, has_exception: Column | None = None) -> Column:
    """The signal of an event's text, null if it has none; an event with an exception has one."""
    out = F.lit(None).cast("string") if has_exception is None else F.when(has_exception, "RuntimeException")
    for name, _, pattern in reversed(BY_RANK):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def failure_classes(text: Column) -> Column:
    """All categories that match, the most telling first."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in CATEGORIES)))


def normalised(message: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(message, r"[0-9]+", "#"), r"\s+", " ")))


def tagged(*parts: Column) -> Column:
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def strict_fingerprint(*parts: Column) -> Column:
    return F.sha2(tagged(*parts), 256)


def fuzzy_fingerprint(exception: Column, message: Column, frames: Column) -> Column:
    """Simple name, normalised message, and frames as class and method without lines."""
    simple = F.element_at(F.split(exception, r"\."), -1)
    return F.sha2(F.concat_ws("\x1f", simple, normalised(message), F.array_join(frames, "|")), 256)


def chain(text: Column) -> Column:
    """The exceptions that an event's text names, outermost first."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^(?:Caused by: |Suppressed: )?((?:[A-Za-z_$][\w$]*\.)+[\w$]*(?:Exception|Error))"), 1)


def frames(text: Column) -> Column:
    """class.method of each frame, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(FRAME), 1), lambda c: c)


#: Who a frame's class belongs to, by how its name begins.
FRAME_KINDS = (
    ("jdk", ("java.", "javax.", "jdk.", "sun.")),
    ("minecraft", ("net.minecraft.", "com.mojang.")),
    ("framework", ("net.minecraftforge.", "net.neoforged.", "net.fabricmc.", "org.spongepowered.")),
)


def frame_kind(cls: Column) -> Column:
    out = F.lit("mod-or-library")
    for kind, prefixes in reversed(FRAME_KINDS):
        for p in prefixes:
            out = F.when(F.startswith(cls, F.lit(p)), kind).otherwise(out)
    return out


def mention_score(base: Column, position: Column) -> Column:
    return F.greatest(F.lit(0.4), base - 0.08 * position)


def terminality(df: DataFrame) -> DataFrame:
    """df with terminality. df: source, ordinal, level, and flags background, watchdog, aborted,
    crash_report, recovery. Only failures have one."""
    df = with_later(df, ["source"], "ordinal", crash_report="_report_later", recovery="_recovery_later")
    failure = F.col("level").isin("ERROR", "FATAL")
    kind = F.when(
        failure,
        F.when(F.col("background"), "background").when(F.col("watchdog"), "watchdog").when(F.col("aborted"), "loader-abort")
        .when(F.col("crash_report") | F.col("_report_later"), "crash").when(F.col("level") == "FATAL", "fatal").when(F.col("_recovery_later"), "recovered").otherwise("unknown"),
    )
    return df.withColumn("terminality", kind).drop("_report_later", "_recovery_later")


#: What ends a process.
TERMINAL = ("crash", "fatal", "watchdog", "loader-abort", "stopped")


def relevance(has_exception: Column, terminal: Column, level: Column) -> Column:
    """(label, score) of an event for a crash."""
    label = (
        F.when(has_exception & F.coalesce(terminal.isin(*TERMINAL), F.lit(False)), "causal")
        .when(has_exception & F.coalesce(terminal == "unknown", F.lit(False)), "unknown")
        .when(level.isin("ERROR", "FATAL") & ~F.coalesce(terminal.isin("recovered", "background"), F.lit(False)), "contributing").otherwise("background")
    )
    score = F.when(label == "causal", 100).when(label == "contributing", 65).when(label == "unknown", 40).otherwise(15)
    return F.struct(label.alias("label"), score.alias("score"))


def blame(frames_: DataFrame) -> DataFrame:
    """frames_: (crash, index, owners array). The first frame with one owner; else the owners that
    share its first owned frame."""
    owned = frames_.where(F.size("owners") > 0)
    sole = owned.where(F.size("owners") == 1).groupBy("crash").agg(F.min_by(F.col("owners")[0], "index").alias("blamed"))
    shared = owned.groupBy("crash").agg(F.min_by(F.array_join("owners", ","), "index").alias("first_owners"))
    return shared.join(sole, "crash", "left").select("crash", "blamed", F.when(F.col("blamed").isNull(), F.col("first_owners")).alias("ambiguous"))


def collapsed_path(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Names in order with runs of one name said once."""
    last = F.lag(name).over(W.partitionBy(key).orderBy(at))
    kept = rows.withColumn("_l", last).where(F.col("_l").isNull() | (F.col("_l") != F.col(name)))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, name))), lambda x: x[name]), " > ").alias("path"))


def subject_name(raw: Column) -> Column:
    """A subject as it is joined on: class paths with dots, ids in lower case."""
    x = F.regexp_replace(F.trim(raw), r"(\.class)+$", "")
    kept = F.contains(x, F.lit(".")) & x.rlike("^[a-z]")
    return F.when(F.contains(x, F.lit("/")), F.replace(x, F.lit("/"), F.lit("."))).when(kept, x).otherwise(F.lower(x))


def attributed(lines: DataFrame) -> DataFrame:
    """(source, category, subject) of the lines that name whom their failure concerns, each once."""
    category = F.get(failure_classes(F.col("text")), F.lit(0))
    found = F.array(*(F.when(category == c, F.nullif(subject_name(F.regexp_extract("text", p, g)), F.lit(""))) for c, p, g in SUBJECTS))
    rows = lines.select("source", category.alias("category"), F.explode(F.array_compact(found)).alias("subject"))
    return rows.distinct()


def removals(lines: DataFrame) -> DataFrame:
    """(source, line_no, engine, kind, via, id): what each line of a script log removes, by the
    first marker that fits."""
    each = [
        F.when(F.col("text").rlike(p), F.struct(F.lit(e).alias("engine"), F.lit(k).alias("kind"), F.lit(v).alias("via"), F.lower(F.regexp_extract("text", p, 1)).alias("id")))
        for e, k, v, p in REMOVALS
    ]
    first = F.get(F.array_compact(F.array(*each)), F.lit(0))
    return lines.select("source", "line_no", first.alias("r")).where("r is not null").select("source", "line_no", "r.*")


def occurrence(text: Column, source: Column, ordinal: Column, event: Column) -> Column:
    """An id of one event of one log."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 12)
    return F.concat_ws(":", short(text), short(source), ordinal, event)


def with_later(rows: DataFrame, by: list[str], order: str, **flags: str) -> DataFrame:
    """rows with, for each flag column, whether a later row of the same log has it: the place of the
    last such row is all that a log must tell its rows."""
    last = rows.groupBy(*by).agg(*[F.max(F.when(F.col(f), F.col(order))).alias(f"_last_{i}") for i, f in enumerate(flags)])
    out = rows.join(last, by, "left")
    for i, name in enumerate(flags.values()):
        out = out.withColumn(name, F.coalesce(F.col(f"_last_{i}") > F.col(order), F.lit(False))).drop(f"_last_{i}")
    return out


def runs(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Rows at which the name changes, in the order of at."""
    last = F.lag(name).over(W.partitionBy(*keys).orderBy(at))
    return rows.select("*", last.alias("before")).where(F.col("before").isNull() | (F.col("before") != F.col(name))).drop("before")
