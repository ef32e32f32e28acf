"""Chat records of many layouts, brought to canonical turns and written in one reversible template.

Method: a record's layout is the set of its nested field paths (`messages[].role`); a hash of the sorted paths selects a
declarative mapping that says where roles and texts stand. Records of a layout without a mapping come out with layout null.

Template: each turn is `### Role: text</turn>` and a line end. Inside roles and texts a backslash, three and more #, and
</turn> are escaped, so that the marks are only marks; unescaping restores any text. The loss mask covers the escaped texts of
assistant turns. The formatted rows are a table in turn order, so a conversation of any length is written and read turn by turn.

Scale: mapping and formatting are maps over records. Reading back needs a conversation's turns in order: they are dealt by
conversation and sorted by Spark on disk, then read one at a time with running digests; no conversation is held as a whole.

Defined cases: null role and text are empty; a null conv_id is one conversation. Turns with equal numbers order by role, then
text; repeated rows stay repeated. Null turn numbers come first. Numbers written as strings are numbers; numbers that no 64 bits hold
are null; half a surrogate pair is U+FFFD; an item of a list that is no object is a text without role. Records that are no JSON
object, or are nested too deeply, are a row with their text. Very long texts are read whole, in slices of rows. Other columns are
not read. An empty table gives an empty one.
"""

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import row_slices, rows_to_batch

# Names that data sets use for the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: Mappings: the field paths of a layout, then where its turns are. `each` names a list whose items are turns, with the turn's number
#: under `at` if they have one; `fields` gives (role, path) of turns in order, and those that are empty are left out unless they are
#: the assistant's or the record says (`turn`) where it begins, so that its turns are whole.
MAPPINGS = (
    {"name": "rows", "paths": ("conv_id", "turn", "role", "text"), "turn": "turn", "role": "role", "text": "text"},
    {"name": "messages", "paths": ("conv_id", "messages[].role", "messages[].content"), "each": "messages", "role": "role", "text": "content"},
    {"name": "numbered-messages", "paths": ("conv_id", "messages[].turn", "messages[].role", "messages[].content"), "each": "messages", "at": "turn", "role": "role", "text": "content"},
    {"name": "conversations", "paths": ("conv_id", "conversations[].from", "conversations[].value"), "each": "conversations", "role": "from", "text": "value"},
    {"name": "numbered-conversations", "paths": ("conv_id", "conversations[].id", "conversations[].from", "conversations[].value"), "each": "conversations", "at": "id", "role": "from", "text": "value"},
    {"name": "dialog", "paths": ("conv_id", "dialog[].speaker", "dialog[].utterance"), "each": "dialog", "role": "speaker", "text": "utterance"},
    {"name": "numbered-dialog", "paths": ("conv_id", "dialog[].n", "dialog[].speaker", "dialog[].utterance"), "each": "dialog", "at": "n", "role": "speaker", "text": "utterance"},
    {"name": "prompt-response", "paths": ("conv_id", "prompt", "response"), "fields": (("user", "prompt"), ("assistant", "response"))},
    {"name": "turn-prompt-response", "paths": ("conv_id", "turn", "prompt", "response"), "turn": "turn", "fields": (("user", "prompt"), ("assistant", "response"))},
    {"name": "prompt-completion", "paths": ("conv_id", "prompt", "completion"), "fields": (("user", "prompt"), ("assistant", "completion"))},
    {"name": "question-answer", "paths": ("conv_id", "question", "answer"), "fields": (("user", "question"), ("assistant", "answer"))},
    {"name": "instruction", "paths": ("conv_id", "instruction", "output"), "fields": (("user", "instruction"), ("assistant", "output"))},
    {"name": "turn-instruction", "paths": ("conv_id", "turn", "instruction", "output"), "turn": "turn", "fields": (("user", "instruction"), ("assistant", "output"))},
    {"name": "instruction-input", "paths": ("conv_id", "instruction", "input", "output"), "fields": (("user", "instruction+input"), ("assistant", "output"))},
    {"name": "system-prompt", "paths": ("conv_id", "system", "prompt", "response"), "fields": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
)
_SPECIAL = re.compile(r"[\\.\[]")


def field_paths(value, prefix: str = "") -> set[str]:
    """The nested field paths of a record; items of a list share `[]`. Dots and brackets of a name stand behind a backslash."""
    if isinstance(value, dict):
        names = {k: _SPECIAL.sub(r"\\\g<0>", k) for k in value}
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{names[k]}" if prefix else names[k])} or {prefix}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, prefix + "[]")} or {prefix + "[]"}
    return {prefix}


def schema_fingerprint(paths) -> str:
    import xxhash

    return xxhash.xxh3_64_hexdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


def registry(mappings=MAPPINGS) -> dict[str, dict]:
    found = {schema_fingerprint(m["paths"]): m for m in mappings}
    for m in mappings:  # a list without items shows none of their fields
        if "each" in m:
            found.setdefault(schema_fingerprint([p for p in m["paths"] if not p.startswith(m["each"])] + [m["each"] + "[]"]), m)
    return found


def _text(value) -> str:
    """A value as text; half of a surrogate pair, which no UTF-8 can hold, is U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _number(value) -> int | None:
    """A whole number of 64 bits, also one written as a string of digits; else None."""
    if isinstance(value, str) and re.fullmatch(r"-?[0-9]{1,19}", value):
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def record_turns(record: dict, mapping: dict) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of a record by its mapping."""
    if "each" in mapping:
        items = [x if isinstance(x, dict) else {mapping["text"]: x} for x in record[mapping["each"]]]
        return [(_number(x.get(mapping["at"])) if "at" in mapping else i, ROLES.get(r := _text(x.get(mapping["role"])), r), _text(x.get(mapping["text"]))) for i, x in enumerate(items)]
    if "fields" in mapping:
        turns = [(role, "\n".join(t for p in path.split("+") if (t := _text(record.get(p))))) for role, path in mapping["fields"]]
        first = _number(record.get(mapping["turn"])) if "turn" in mapping else None
        if "turn" in mapping:
            return [(first if first is None else first + i, role, text) for i, (role, text) in enumerate(turns)]
        return [(i, role, text) for i, (role, text) in enumerate((r, t) for r, t in turns if t or r == "assistant")]
    return [(_number(record.get(mapping["turn"])), _text(record.get(mapping["role"])), _text(record.get(mapping["text"])))]  # already canonical: roles stay


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])


def canonical_turns(records: DataFrame, column: str = "record", mappings=MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text, layout of JSON records.

    A record that is no JSON object, is nested too deeply to be read, or has no mapping, is one row with its text and a null layout.
    Numbers of conversations and turns that aren't whole numbers of 64 bits are null.
    """

    def run(batches):
        known, memo = registry(mappings), {}
        for batch in batches:
            for _, part in row_slices(batch, [column]):
                out = {f.name: [] for f in _TURNS}
                for raw in part.column(0).to_pylist():
                    record = mapping = None
                    try:
                        record = json.loads(raw or "null")
                        if isinstance(record, dict):
                            paths = frozenset(field_paths(record))
                            mapping = memo.setdefault(paths, known.get(schema_fingerprint(paths))) if len(memo) < 10_000 else known.get(schema_fingerprint(paths))
                    except (ValueError, RecursionError):
                        record = None
                    conv = _number(record.get("conv_id")) if isinstance(record, dict) else None
                    turns = record_turns(record, mapping) if mapping else [(None, "", raw or "")]
                    for turn, role, text in turns:
                        for c, v in zip(out.values(), (conv, turn, role, text, mapping and mapping["name"])):
                            c.append(v)
                yield rows_to_batch(_TURNS, out)

    return records.select(column).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


_HASHES = re.compile("#{3,}")
_ESCAPED = re.compile(r"\\([\\hlc])")
_OF = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
END = "</turn>\n"


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "###" in text:
        text = _HASHES.sub(lambda m: "\\h" * len(m[0]), text)
    return text.replace("</turn>", "\\l/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _OF[m[1]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted, start and end of the text in it); the span is under the loss mask if the role is the assistant's."""
    head = f"### {escape(role).replace(':', chr(92) + 'c')}: "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(formatted: str):
    """(role, text) of each turn of formatted text."""
    for part in formatted.split(END)[:-1]:
        role, _, body = part[4:].partition(": ")
        yield unescape(role), unescape(body)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end of each turn; the span is in code points of formatted, empty without loss.

    The formatted conversation is its rows' texts in the order of turn, formatted (see sorted_turns).
    """

    def run(batches):
        for batch in batches:
            for _, part in row_slices(batch, ["text"]):
                out = {f.name: [] for f in _FORMATTED}
                for conv, turn, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                    formatted, start, end = format_turn(role or "", text or "")
                    masked = (role or "") == "assistant"
                    for c, v in zip(out.values(), (conv, turn, formatted, start if masked else 0, end if masked else 0)):
                        c.append(v)
                yield rows_to_batch(_FORMATTED, out)

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


class _Digests:
    """Running digests of one conversation, read from its formatted turns."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted, start, end):
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        text = unescape(formatted[start:end])
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self):
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss of each conversation, parsed from the formatted rows."""

    def run(batches):
        held = None
        for batch in batches:
            for _, part in row_slices(batch, ["formatted"]):
                done = []
                for conv, text, start, end in zip(*(part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                    if held is None or held.conv_id != conv:
                        done += [held.row()] if held else []
                        held = _Digests(conv)
                    held.read(text, start, end)
                if done:
                    yield rows_to_batch(_READ, dict(zip(_READ.names, zip(*done))))
        if held:
            yield rows_to_batch(_READ, dict(zip(_READ.names, zip(*[held.row()]))))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def row_records(conversations: DataFrame) -> DataFrame:
    """Each row of a table of turns as a JSON record of the layout `rows`."""
    fields = F.struct("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


#: Turns of a record in a layout with a list.
LISTED = 8


def dealt_records(conversations: DataFrame) -> DataFrame:
    """A table of turns as JSON records of six layouts, which conv_id chooses: as data sets from many sources would hold them.

    Neighbouring turns are brought together by conversation and number, at most LISTED in a record, so that no record grows with
    its conversation. Two turns that aren't a user's and an assistant's are no pair: they are listed. What a layout can't say
    (a null turn, a role that it would rename) is a record of the layout `rows`.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("layout", F.when(F.col("turn").isNull() | F.col("role").isin(*ROLES), 0).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(6))))
    few = F.when(F.col("layout") >= 4, 2).otherwise(LISTED)
    place = Window.partitionBy("conv_id", "layout", F.floor(F.col("turn") / few)).orderBy("turn", "role", "text")
    numbered = rows.where("layout > 0").withColumns({"few": few, "nth": F.row_number().over(place) - 1})
    parts = numbered.groupBy("conv_id", "layout", F.floor(F.col("turn") / F.col("few")), F.floor(F.col("nth") / F.col("few"))).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def listed(name, at, role, text, roles=lambda r: r):
        item = lambda t: F.struct(t["turn"].alias(at), roles(t["role"]).alias(role), t["text"].alias(text))
        return F.to_json(F.struct("conv_id", F.transform("t", item).alias(name)), {"ignoreNullFields": "false"})

    def pair(prompt, response):
        fields = F.struct("conv_id", F.col("t")[0]["turn"].alias("turn"), F.col("t")[0]["text"].alias(prompt), F.get("t", F.lit(1))["text"].alias(response))
        return F.to_json(fields, {"ignoreNullFields": "false"})

    first, second = F.col("t")[0], F.get("t", F.lit(1))
    paired = (F.size("t") == 2) & (first["role"] == "user") & (second["role"] == "assistant") & (second["turn"] == first["turn"] + 1)
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(paired & (F.col("layout") == 4), pair("prompt", "response")).when(paired & (F.col("layout") == 5), pair("instruction", "output"))
        .when(F.col("layout") == 2, listed("conversations", "id", "from", "value", named)).when(F.col("layout") == 3, listed("dialog", "n", "speaker", "utterance"))
        .otherwise(listed("messages", "turn", "role", "content"))
    )
    return row_records(rows.where("layout = 0")).union(parts.select(record.alias("record")))
