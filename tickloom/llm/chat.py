"""Chat records of any layout as canonical turns, one training text and a loss mask.

A record is a JSON text. Its fingerprint is a hash of the set of its nested field paths (list elements as
``[]``), so two records with the same layout have the same fingerprint whatever they say. The
fingerprint selects a declarative ``Mapping``: a mapping names the paths it needs and the paths it
tolerates, and is entered under the fingerprint of every such combination. Its ``turns`` say where roles
and texts are found; a role may be fixed, read from a field, or renamed.

Template: ``<turn>role`` newline, text, ``</turn>`` newline, for each turn. Inside roles and texts a backslash is
doubled, and ``<turn>`` and ``</turn>`` lose their ``<`` to ``\\l``; a newline in a role is ``\\n``. The
control strings therefore occur nowhere but where the template put them, and unescaping gives the exact text back.
The loss mask is a list of code-point ranges of the formatted text: the escaped text of each assistant turn.

Null or missing texts are empty; records that are no JSON object or nested too deeply to parse, whose layout no mapping
knows, or that hold half a surrogate pair come back with a null ``formatted`` (and their fingerprint, if they were parsed). A record is one row and is formatted in linear time.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import findable

OPEN, CLOSE = "<turn>", "</turn>\n"
CONTROL = re.compile(r"<(?=/?turn>)")
ESCAPED = re.compile(r"\\(.)", re.S)
BACK = {"l": "<", "n": "\n", "\\": "\\"}


@dataclass(frozen=True)
class Turn:
    """Where turns are found: in each element of the list ``each`` (or once, in the record itself)."""
    text: str
    role: str | None = None      # field that holds the role
    fixed: str | None = None     # or the role itself
    each: str | None = None
    append: str | None = None    # a second text, after a blank line if not empty


@dataclass(frozen=True)
class Mapping:
    name: str
    turns: tuple[Turn, ...]
    needs: frozenset[str]
    may: frozenset[str] = frozenset()
    rename: dict = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        return [path_hash(self.needs | set(c)) for n in range(len(self.may) + 1) for c in combinations(sorted(self.may), n)]


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", (Turn("content", role="role", each="messages"),),
            frozenset({"messages", "messages[]", "messages[].role", "messages[].content"}), rename=SPOKEN),
    Mapping("conversations", (Turn("value", role="from", each="conversations"),),
            frozenset({"conversations", "conversations[]", "conversations[].from", "conversations[].value"}), rename=SPOKEN),
    Mapping("prompt", (Turn("prompt", fixed="user"), Turn("completion", fixed="assistant")), frozenset({"prompt", "completion"})),
    Mapping("response", (Turn("prompt", fixed="user"), Turn("response", fixed="assistant")), frozenset({"prompt", "response"})),
    Mapping("question", (Turn("question", fixed="user"), Turn("answer", fixed="assistant")), frozenset({"question", "answer"})),
    Mapping("instruction", (Turn("system", fixed="system"), Turn("instruction", fixed="user", append="input"), Turn("output", fixed="assistant")),
            frozenset({"instruction", "output"}), frozenset({"input", "system"})),
    Mapping("nested", (Turn("instruction.system", fixed="system"), Turn("instruction.user", fixed="user"), Turn("output.text", fixed="assistant")),
            frozenset({"instruction", "instruction.user", "output", "output.text"}), frozenset({"instruction.system"})),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record."""
    out, todo = set(), [(value, at)]
    while todo:
        v, p = todo.pop()
        if p:
            out.add(p)
        if isinstance(v, dict):
            todo += [(x, f"{p}.{k}" if p else k) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, f"{p}[]") for x in v]
    return out


def path_hash(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _string(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) turns of a record."""
    out = []
    for t in mapping.turns:
        for item in record.get(t.each) or [] if t.each else [record]:
            if not t.each and _at(item, t.text) is None and t.text in mapping.may:
                continue
            text = _string(_at(item, t.text))
            more = _string(_at(item, t.append)) if t.append else ""
            role = t.fixed if t.fixed is not None else _string(_at(item, t.role))
            out.append((mapping.rename.get(role, role), f"{text}\n\n{more}" if more else text))
    return out


def escape(text: str) -> str:
    return CONTROL.sub(r"\\l", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK.get(m[1], m[0]), text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The training text and its loss mask."""
    out, mask, n = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            mask.append((n + len(head), n + len(head) + len(body)))
        out += [head, body, CLOSE]
        n += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def _formatted(record: dict, mapping: Mapping) -> tuple[str | None, list[tuple[int, int]]]:
    """The formatted record; None where it is nested too deeply or holds half a surrogate pair, which no text column can."""
    try:
        formatted, mask = format_turns(canonical(record, mapping))
        formatted.encode()
    except (RecursionError, UnicodeEncodeError):
        return None, []
    return formatted, mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FORMATTED = pa.schema([("key", pa.int64()), ("fingerprint", pa.string()), ("mapping", pa.string()), ("formatted", pa.string()), ("loss", MASK)])


def convert(records: DataFrame, key_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """key, fingerprint, mapping, formatted, loss of every record."""
    table = {f: m for m in mappings for f in m.fingerprints()}
    messages = {f: m for m in mappings if any(t.each for t in m.turns) for f in [path_hash(p for p in m.needs if "[]" not in p)]}

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = {"key": key, "fingerprint": None, "mapping": None, "formatted": None, "loss": None}
                try:
                    record = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    record = None
                if isinstance(record, dict):
                    row["fingerprint"] = path_hash(paths(record))
                    m = table.get(row["fingerprint"]) or messages.get(row["fingerprint"])  # an empty list has no element paths
                    formatted, mask = _formatted(record, m) if m else (None, [])
                    if formatted is not None:
                        row |= {"mapping": m.name, "formatted": formatted, "loss": [{"start": s, "end": e} for s, e in mask]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=FORMATTED)

    return findable(records).select(F.col(key_col).cast("long").alias("key"), F.col(json_col).cast("string").alias("record")).mapInArrow(
        run, "key long, fingerprint string, mapping string, formatted string, loss array<struct<start:int,end:int>>")


def records_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record per conversation of a table of turns, in the layout that its roles suggest: a user and
    an assistant turn become prompt and completion, system, user and assistant become the nested layout,
    everything else a list of messages. Turns that share a number follow one another by role and text."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    g = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    said = F.transform("t", lambda x: x.role)
    text = lambda i: F.get("t", i).content
    record = (
        F.when(said == F.array(F.lit("user"), F.lit("assistant")),
               F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(said == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
              F.to_json(F.struct(F.struct(text(0).alias("system"), text(1).alias("user")).alias("instruction"), F.struct(text(2).alias("text")).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages")))))
    return g.select("conv_id", record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted text and the mask alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            rows = []
            for key, text, mask in zip(*(c.to_pylist() for c in b.columns)):
                turns = parse(text or "")
                loss = "".join(unescape(text[m["start"]:m["end"]]) for m in mask or [])
                rows.append({"conv_id": key, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                             "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text or "")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return formatted.select("key", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
