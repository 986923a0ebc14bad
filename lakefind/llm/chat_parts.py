"""Chat formatting with typed content parts.

A message's content is a list of typed parts.  A visitor with one method for
each kind of part (text, image, audio, document) walks the list in order and
flattens it: text stays, an attachment becomes a placeholder whose number is its
place in the conversation.  For each attachment the visitor records what it
refers to and how many tokens the placeholder expands to; text is counted with a
public tokenizer whose file is a parameter.

Content is plain text, or a JSON array of parts, or a JSON object with a
``content`` or ``parts`` array:

    {"type": "text", "text": "..."}
    {"type": "image" | "image_url", "url" | "image_url" | "source": ref, "width": w, "height": h}
    {"type": "audio" | "input_audio", "url" | "audio" | "source": ref, "seconds": s}
    {"type": "document" | "file", "url" | "file" | "source": ref, "pages": n}

A reference may be a string or an object with a url, id, file_id or data member.

Turns are brought together by one shuffle on conv_id and part, a part being so
many turn numbers, and formatted in turn order: a task never holds more than a
part, however long a conversation is.  Nothing else is shuffled or collected.

Defined results
---------------
* Expanded tokens: an image takes ``image_base`` + ``image_tile`` for each tile of
  ``tile`` x ``tile`` pixels begun (one tile if a size is missing or not above 0); audio
  takes ``audio_rate`` a second begun (at least one second); a document takes
  ``page_tokens`` a page (at least one).  Roles and turn marks are counted as text.
* Text that is not such JSON is one text part, as it is.  A part of unknown type
  is kept as text of its JSON, so that nothing is lost.
* A null role is "unknown"; a null text is a message without parts; both stay.
* Turns are ordered by turn (null first), then role, then text; repeated rows
  are repeated turns.  A row with a null conv_id is a conversation of its own.
* A conversation is cut into parts of ``part_turns`` turn numbers, numbered from
  the turn divided by it (null turns are in part 0); each part is a row, and its
  attachments are numbered from 0.
* A text cannot forge a mark: "<|" is written as "<||" in it (and "<||" as
  "<|||"), so "<|" before a letter is always one of ours; :func:`unescape` takes
  it back.  In roles, other characters than letters, digits, "_", "-" and "." are
  written as "_".  An attachment has the offset of its placeholder in characters.
* An empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col

#: The default vocabulary; the path has to exist where tasks run.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging, as the vocabulary's own pattern has it.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ROLE = re.compile(r"[^\w.-]")
#: Turn numbers of a part.
PART_TURNS = 1000

_ENCODINGS: dict[str, object] = {}


def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a rank file, read once in a process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments expand to."""

    tile: int = 512
    image_tile: int = 170
    image_base: int = 85
    audio_rate: int = 25
    page_tokens: int = 600


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: float
    height: float

    def accept(self, visitor):
        return visitor.image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: float

    def accept(self, visitor):
        return visitor.document(self)


def _reference(part: dict, *names: str) -> str:
    for n in names:
        v = part.get(n)
        if isinstance(v, dict):
            v = next((v[k] for k in ("url", "id", "file_id", "data") if isinstance(v.get(k), str)), None)
        if isinstance(v, str):
            return v
    return ""


def _number(part: dict, name: str) -> float:
    v = part.get(name)
    if isinstance(v, bool) or not isinstance(v, int | float) or not 0 < v < 1e12:
        return 0
    return v


def _part(x) -> TextPart | ImagePart | AudioPart | DocumentPart:
    kind = x.get("type") if isinstance(x, dict) else None
    if kind == "text" and isinstance(x.get("text"), str):
        return TextPart(x["text"])
    if kind in ("image", "image_url"):
        return ImagePart(_reference(x, "url", "image_url", "image", "source"), _number(x, "width"), _number(x, "height"))
    if kind in ("audio", "input_audio"):
        return AudioPart(_reference(x, "url", "audio", "input_audio", "source"), _number(x, "seconds"))
    if kind in ("document", "file"):
        return DocumentPart(_reference(x, "url", "file", "document", "source"), _number(x, "pages"))
    return TextPart(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))


def parse_content(text: str | None) -> list:
    """The parts of a message's content."""
    if text is None:
        return []
    if text.lstrip()[:1] in ("[", "{"):
        try:
            x = json.loads(text)
        except (ValueError, RecursionError):
            return [TextPart(text)]
        if isinstance(x, dict):
            x = next((x[k] for k in ("content", "parts") if isinstance(x.get(k), list)), [x] if isinstance(x.get("type"), str) else None)
        if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in x):
            return [_part(p) for p in x]
    return [TextPart(text)]


def escape(text: str) -> str:
    """The text with its own "<|" made plain: no mark of the format has a bar there."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


@dataclass
class Flattener:
    """The visitor: flattens the parts of a conversation into text with placeholders."""

    expansion: Expansion = field(default_factory=Expansion)
    out: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    pending: str = ""
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def text(self, part: TextPart) -> None:
        self.pending += part.text

    def settle(self) -> None:
        """Write the text so far: escaped as a whole, so that no two parts make a mark together."""
        if self.pending:
            self.write(escape(self.pending), True)
            self.pending = ""

    def write(self, text: str, plain: bool) -> None:
        self.out.append(text)
        self.length += len(text)
        if plain:
            self.plain.append(text)

    def image(self, part: ImagePart) -> None:
        e = self.expansion
        tiles = ceil(part.width / e.tile) * ceil(part.height / e.tile) if part.width and part.height else 1
        self._attach("image", part.ref, e.image_base + e.image_tile * tiles)

    def audio(self, part: AudioPart) -> None:
        self._attach("audio", part.ref, self.expansion.audio_rate * max(1, ceil(part.seconds)))

    def document(self, part: DocumentPart) -> None:
        self._attach("document", part.ref, self.expansion.page_tokens * max(1, ceil(part.pages)))

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.settle()
        n = len(self.attachments)
        self.attachments.append({"number": n, "kind": kind, "ref": ref, "tokens": tokens, "offset": self.length})
        self.write(f"<|{kind}_{n}|>", False)


def flatten(turns: list[tuple[str | None, str | None]], expansion: Expansion) -> tuple[str, str, list[dict]]:
    """A conversation's text with placeholders, its text without them, and its attachments."""
    v = Flattener(expansion)
    for role, text in turns:
        v.write(f"<|{_ROLE.sub('_', role) if role else 'unknown'}|>\n", True)
        for part in parse_content(text):
            part.accept(v)
        v.settle()
        v.write("\n<|end|>\n", True)
    return "".join(v.out), "".join(v.plain), v.attachments


def format_chats(
    messages: DataFrame,
    *,
    conv_id="conv_id",
    turn="turn",
    role="role",
    text="text",
    tokenizer_path: str = TOKENIZER,
    expansion: Expansion | None = None,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row a part of a conversation: conv_id, part, n_turns, formatted, attachments, text_tokens, attachment_tokens, n_tokens."""
    use = expansion or Expansion()
    m = bounded_batches(messages).select(*[col(messages, c).alias(a) for c, a in ((conv_id, "c"), (turn, "n"), (role, "r"), (text, "t"))])
    turn_row = F.struct("n", "r", "t")
    named = m.where(F.col("c").isNotNull()).withColumn("p", F.coalesce(F.floor(F.col("n") / part_turns), F.lit(0)).cast("long"))
    grouped = named.groupBy("c", "p").agg(F.sort_array(F.collect_list(turn_row)).alias("turns"))
    grouped = grouped.unionByName(m.where(F.col("c").isNull()).select("c", F.lit(0).cast("long").alias("p"), F.array(turn_row).alias("turns")))
    attachment = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("offset", T.IntegerType())])
    schema = T.StructType(
        [T.StructField("conv_id", messages.schema[conv_id].dataType), T.StructField("part", T.LongType()), T.StructField("n_turns", T.IntegerType()), T.StructField("formatted", T.StringType()), T.StructField("attachments", T.ArrayType(attachment))]
        + [T.StructField(c, T.LongType()) for c in ("text_tokens", "attachment_tokens", "n_tokens")]
    )
    attached = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("offset", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [flatten([(x["r"], x["t"]) for x in turns], use) for turns in part.column(2).to_pylist()]
                text_tokens = [len(encoding.encode_ordinary(plain)) for _, plain, _ in rows]
                extra = [sum(a["tokens"] for a in att) for *_, att in rows]
                sizes = part.column(2).value_lengths()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), sizes, pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], attached), pa.array(text_tokens, pa.int64()), pa.array(extra, pa.int64()), pa.array([a + b for a, b in zip(text_tokens, extra)], pa.int64())],
                    names=schema.names,
                )

    return grouped.mapInArrow(run, schema)

