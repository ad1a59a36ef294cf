"""Chat formatting: records of different layouts into canonical turns, one template, a loss mask.

A record is JSON. Its schema fingerprint is a hash of its nested field paths, and a table of
declarative mappings, keyed by fingerprint, says where the turns are. Text inside a turn is escaped
so that it holds none of the control strings, and what is formatted reads back as it was. All of it
is DataFrame functions.

A JSON parser takes strings up to a length and a variant has a size limit, so the strings of a long
record are taken out before it is parsed, a mark with their place left for each, and put back into
its turns. A record is one row: it and what is formatted of it are bound by Spark's 2 GB for a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Records with more characters are parsed without their strings.
LONG_RECORD = 1 << 20
#: Strings with at most so many characters, keys among them, stay in a long record.
KEPT = 32
#: Characters in a part of a formatted text, from which masked spans are read.
PART = 4096
#: Stand-ins of an escaped backslash and quote, and the ends of a mark.
_BACKSLASH, _QUOTE, _MARK = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Mapping:
    """shape: an example record as JSON, whose field paths select this mapping. many: the path of
    an array of turns with fields role and text; else turns: (role, path of the text) in order,
    where a missing or null text gives no turn."""

    name: str
    shape: str
    many: str | None = None
    role: str = "role"
    text: str = "text"
    turns: tuple[tuple[str, str], ...] = ()


#: Role names of the layouts that have a field of their own for them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', "$.messages", text="content"),
    Mapping("turns", '{"turns":[{"role":"","text":""}]}', "$.turns"),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', "$.conversations", "from", "value"),
    Mapping("prompt", '{"prompt":"","response":""}', turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("completion", '{"prompt":"","completion":""}', turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("instruction", '{"instruction":"","output":""}', turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping(
        "instruction-input", '{"instruction":"","input":"","output":""}',
        turns=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
    Mapping(
        "system-prompt", '{"system":"","prompt":"","response":""}',
        turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")),
    ),
)


def fingerprint(record: Column) -> Column:
    """Hash of a variant's nested field paths, types of scalars left aside."""
    shape = F.schema_of_variant(record)
    scalar = r"\b(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
    # An empty array has no paths below it; its turns are none under any mapping of its outer path.
    return F.sha2(F.regexp_replace(shape, scalar, "x"), 256)


def mapping_table(spark: SparkSession, mappings=MAPPINGS) -> DataFrame:
    """(fingerprint, mapping): one row for each mapping."""
    rows = spark.createDataFrame([(m.name, m.shape) for m in mappings], "mapping string, shape string")
    return rows.select(fingerprint(F.parse_json("shape")).alias("fingerprint"), "mapping")


def _without_strings(record: Column) -> tuple[Column, Column]:
    """(pieces, moved) of a JSON text cut at its quotes: every second piece is a string's inside,
    and moved says where one is to be taken out."""
    for sign in (_BACKSLASH, _QUOTE, _MARK):
        record = F.replace(record, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    record = F.replace(record, F.lit("\\\\"), F.lit(_BACKSLASH))
    pieces = F.split(F.replace(record, F.lit('\\"'), F.lit(_QUOTE)), '"')
    # A string that itself holds the sign of a mark always goes.
    marked = lambda x: x.rlike(rf"(?i)\\u{ord(_MARK):04x}")
    return pieces, F.transform(pieces, lambda x, i: (i % 2 == 1) & ((F.length(x) > KEPT) | marked(x)))


def _restored(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def parsed(records: DataFrame, record: str, variant: str, strings: str, long_record: int = LONG_RECORD) -> DataFrame:
    """records with two more columns: the record as a variant, null if it isn't JSON, and, of a
    long record, its pieces with the strings decoded that are marked in the variant."""
    long = F.length(record) > long_record
    pieces, moved = _without_strings(F.when(long, F.col(record)))
    got = records.withColumn(strings, pieces).withColumn(variant, moved)
    skeleton = F.zip_with(strings, F.transform(variant, lambda m, i: F.when(m, i)), lambda x, i: F.when(i.isNull(), x).otherwise(F.concat(F.lit(_MARK), i.cast("string"), F.lit(_MARK))))
    decode = lambda x: F.from_json(F.concat(F.lit('["'), _restored(x), F.lit('"]')), "array<string>", {"maxStringLen": str((1 << 31) - 1)})[0]
    texts = F.zip_with(strings, variant, lambda x, m: F.when(m, decode(x)))
    got = got.withColumn(strings, F.struct(_restored(F.array_join(skeleton, '"')).alias("skeleton"), texts.alias("texts"), F.col(variant).alias("moved")))
    bad = F.exists(F.arrays_zip(F.col(strings)["texts"], F.col(strings)["moved"]), lambda x: x["moved"] & x["texts"].isNull())
    whole = F.when(long, F.when(~bad, F.try_parse_json(F.col(strings)["skeleton"]))).otherwise(F.try_parse_json(record))
    return got.withColumn(variant, whole).withColumn(strings, F.when(long, F.col(strings)["texts"]))


def _turns(m: Mapping, record: Column, strings: Column) -> Column:
    """Array of (role, text) under one mapping."""

    def text_of(v, path):
        x = F.try_variant_get(v, path, "string")
        mark = F.regexp_extract(x, rf"^{_MARK}(\d+){_MARK}$", 1)
        return F.when(strings.isNull() | ~x.startswith(_MARK), x).otherwise(F.get(strings, mark.cast("int")))

    if m.many:
        items = F.try_variant_get(record, m.many, "array<variant>")
        raw = F.transform(items, lambda t: F.struct(text_of(t, f"$.{m.role}").alias("role"), F.coalesce(text_of(t, f"$.{m.text}"), F.lit("")).alias("text")))
    else:
        each = [F.struct(F.lit(r).alias("role"), text_of(record, p).alias("text")) for r, p in m.turns]
        raw = F.filter(F.array(*each), lambda t: t["text"].isNotNull())
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    own = lambda t: names[t["role"]] if m.role != "role" else F.lit(None)
    role = lambda t: F.coalesce(own(t), t["role"], F.lit(""))
    return F.transform(raw, lambda t: F.struct(role(t).alias("role"), t["text"].alias("text")))


def canonical(records: DataFrame, mappings=MAPPINGS, long_record: int = LONG_RECORD) -> DataFrame:
    """(id, record, fingerprint, mapping, turns) of records with id and record (JSON); other columns
    are ignored. turns is an array of (role, text). A record that is null, not JSON or of an unknown
    fingerprint has null mapping and turns: it is kept, to be counted and mapped, never guessed at."""
    table = F.broadcast(mapping_table(records.sparkSession, mappings))  # a row for each mapping
    known = parsed(records.select("id", "record"), "record", "v", "strings", long_record)
    known = known.withColumn("fingerprint", fingerprint(F.col("v"))).join(table, "fingerprint", "left")
    turns = F.lit(None)
    for m in mappings:
        turns = F.when(F.col("mapping") == m.name, _turns(m, F.col("v"), F.col("strings"))).otherwise(turns)
    return known.select("id", "record", "fingerprint", "mapping", turns.alias("turns"))


def escaped(text: Column) -> Column:
    """A backslash before each backslash and inside each control string, of this template and of
    the common ones."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(?=\||/?s>)", r"<\\")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """turns has id, at (order), role and text. Returns (id, formatted, loss_spans): spans are
    (start, length) in characters of the formatted text, one for each assistant turn. Null role and
    text: empty. Turns of equal order stand by role, then text."""
    return _formatted(turns.select("id", "at", "role", "text", F.lit(True).alias("real"), F.lit(None).cast("string").alias("mapping"))).drop("mapping")


def _formatted(turns: DataFrame) -> DataFrame:
    """As formatted(); a row that isn't real stands for an id without turns. Keeps mapping."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("id", "at", "real", "mapping", role.alias("role"), escaped(text).alias("body"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    # A row holds its text once; the piece is made where it is collected.
    n_head, n_body = F.length(head).cast("long"), F.length("body").cast("long")
    order = W.partitionBy("id").orderBy("at", "role", "body")
    before = F.sum(F.when(F.col("real"), n_head + n_body + len(END)).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("*", F.row_number().over(order).alias("n"), (F.coalesce(before, F.lit(0)) + n_head).alias("start"))
    piece = F.when(F.col("real"), F.concat(head, "body", F.lit(END))).otherwise("")
    span = F.when((F.col("role") == LOSS_ROLE) & F.col("real"), F.struct("start", n_body.alias("length")))
    pieces = F.array_sort(F.collect_list(F.struct("n", piece.alias("piece"), span.alias("span"))))
    out = rows.groupBy("id").agg(pieces.alias("p"), F.max("mapping").alias("mapping"))
    return out.select(
        "id",
        F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        "mapping",
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(id, turns, loss): the turns of a formatted text, and all text under its loss mask."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN) + 1, (1 << 31) - 1), r"<\|text\|>", 2))
    turns = F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))
    # A place far into a long string costs a scan up to it, so spans are read from short parts.
    # The parts are named twice below: an expression named once would be moved into the loop.
    parts = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PART}}}"), 0)
    chats = chats.withColumn("parts", parts)

    def masked(s):
        first, last = F.floor(s["start"] / PART), F.floor((s["start"] + s["length"]) / PART)
        held = F.array_join(F.slice("parts", first.cast("int") + 1, F.least(last - first + 1, F.size("parts")).cast("int")), "")
        return unescaped(F.substring(held, (s["start"] - first * PART + 1).cast("int"), s["length"].cast("int")))

    loss = F.array_join(F.transform("loss_spans", masked), "")
    kept = [c for c in ("mapping",) if c in chats.columns]
    return chats.select("id", turns.alias("turns"), loss.alias("loss"), "formatted", *kept)


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record for each conversation, in different
    layouts: a prompt with its response, also below a system text, where the roles are these and no
    more; other conversations as lists of messages, turns or, if all roles have a name there,
    conversations, by their id."""
    turn = F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = F.struct("turn", turn.alias("t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("p"))
    got = got.select(F.col("conv_id").alias("id"), F.transform("p", lambda p: p["t"]).alias("turns"))
    roles, say = F.array_join(F.transform("turns", lambda t: F.to_json(F.array(t["role"]))), ""), lambda i: F.get("turns", F.lit(i))["text"]
    one = lambda *names: F.to_json(F.struct(*(say(i).alias(n) for i, n in enumerate(names))))
    many = lambda name, role, text, called: F.to_json(F.struct(F.transform("turns", lambda t: F.struct(called(t["role"]).alias(role), t["text"].alias(text))).alias(name)))
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    plain = F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant"))
    third = F.pmod(F.coalesce("id", F.lit(2)), F.lit(3))
    record = (
        F.when(roles == '["user"]["assistant"]', one("prompt", "response"))
        .when(roles == '["system"]["user"]["assistant"]', one("system", "prompt", "response"))
        .when(plain & (third == 0), many("conversations", "from", "value", theirs))
        .when(third == 1, many("messages", "role", "content", lambda r: r))
        .otherwise(many("turns", "role", "text", lambda r: r))
    )
    return got.select("id", record.alias("record"))


def digests(records: DataFrame, long_record: int = LONG_RECORD) -> DataFrame:
    """Formats records and tells, from what reads back: (id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, mapping). One row for each id, whose records are taken together
    if it has several. A record that is null, not JSON or of unknown layout has null mapping and
    the row of no turns: zero counts and digests of the empty text. An empty table gives no rows."""
    turns = canonical(records, long_record=long_record).select("id", "mapping", F.posexplode_outer("turns").alias("at", "t"))
    chats = _formatted(turns.select("id", "at", "t.role", "t.text", F.col("t").isNotNull().alias("real"), "mapping"))
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "mapping",
    )


_TURNS = """SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"""
#: The digests of op5's rows in SQL: each escape adds one character.
ORACLE_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({_TURNS}) c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length(role) + length(text)
    + len(regexp_extract_all(role || chr(0) || text, '\\\\|<\\||</?s>|\\[/?INST\\]'))) AS BIGINT) AS formatted_chars,
  CASE WHEN list(role ORDER BY turn, role, text) = ['user', 'assistant'] THEN 'prompt'
    WHEN list(role ORDER BY turn, role, text) = ['system', 'user', 'assistant'] THEN 'system-prompt'
    WHEN bool_and(role IN ('system', 'user', 'assistant')) AND coalesce(conv_id, 2) % 3 = 0 THEN 'conversations'
    WHEN (coalesce(conv_id, 2) % 3 + 3) % 3 = 1 THEN 'messages' ELSE 'turns' END AS mapping
FROM r GROUP BY conv_id
"""
