"""Chat formatting at token level.

Every row's role and text are encoded separately and spliced with reserved ids (turn, body, end)
that no text can produce; the loss mask comes from prefix sums over segment lengths.  Control
strings that occur in content are escaped reversibly, so the written form is safe too: a
backslash goes in after their first character, one more if there are some already.

Rows are encoded where they lie.  Only then are they gathered by conversation in the order of
their turns, and read as a stream: a conversation of any length needs the memory of one turn.

Defined cases: null role and text are empty; rows are ordered by turn (null first), then role and
text, so ties have one order; repeated rows are turns of their own; a null conversation id is one
conversation; a text of any length gives the ids of encoding it whole (it is cut only where the
vocabulary's pattern ends a word in any case); an empty table has no conversations; other columns
of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.tables import read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern by which the vocabulary's words are cut.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# This template's marks, and those of other templates, that content must not hold.
MARKS = ("<|turn|>", "<|body|>", "<|end|>")
CONTROL = (*MARKS, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
#: A text is cut at the first safe place after so many characters.
STRETCH = 1 << 16
#: No word of the pattern goes on from a character that is no space to a space or line feed.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
TRAINED_ROLE = "assistant"

_ADD = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)))
_TAKE = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    """No control string stands in the result; ``unescape`` gives the text back."""
    return _ADD.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _TAKE.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """Text to ids and back; reserved ids follow the vocabulary's."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2  # one id is left to the vocabulary's own end of text
        self.turn, self.body, self.end = first, first + 1, first + 2

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = SAFE.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            out += self.encoding.encode_ordinary(text[at:end])
            at = end
        return out

    def turn_of(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one turn and its loss mask: the trained role's text and the end after it."""
        segments = [[self.turn], self.encode(escape(role)), [self.body], self.encode(escape(text)), [self.end]]
        trained = role == TRAINED_ROLE
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, np.int64)
        if trained:
            steps[ends[2]] += 1
            steps[ends[4]] -= 1
        return np.array([i for s in segments for i in s], np.int32), np.cumsum(steps)[:-1].astype(bool)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None]:
        """Role and text of a turn, and its text under the mask, from its ids alone."""
        body = int(np.flatnonzero(ids == self.body)[0])
        if ids[0] != self.turn or ids[-1] != self.end:
            raise ValueError("a turn is not whole")
        text = lambda x: self.encoding.decode_bytes(x.tolist()).decode()
        under = ids[mask & (ids < self.turn)]
        return unescape(text(ids[1:body])), unescape(text(ids[body + 1 : -1])), unescape(text(under)) if mask.any() else None


_codecs: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    key = vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value)
    return _codecs[key]


def load(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary as a broadcast variable: a file (path or URI) of fixed size, under a megabyte, read by the driver."""
    with shared.open_read(path) as f:
        return spark.sparkContext.broadcast(f.read())


TURNS = "conv_id long, turn long, role string, text string, ids binary, mask binary, formatted string"


def encode(rows: DataFrame, vocabulary, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row as a formatted turn: ids (int32), loss mask (a byte each), and the written form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, masks, written = [], [], []
                for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                    i, m = codec.turn_of(r, t)
                    ids.append(i.tobytes())
                    masks.append(m.tobytes())
                    written.append(MARKS[0] + escape(r) + MARKS[1] + escape(t) + MARKS[2])
                yield pa.record_batch([*part.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary()), pa.array(written, pa.string())], names=[x.split()[0] for x in TURNS.split(", ")])

    own = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(run, TURNS)


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation next to each other, in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask", "formatted")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(ordered: DataFrame, vocabulary) -> DataFrame:
    """One row per conversation, read from the ids and masks: digests of its turns and of its text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        state, done = None, []

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        def close() -> None:
            c, n, turns, chars, loss, written, tokens, trained = state
            done.append((c, n, turns.hexdigest(), chars, loss.hexdigest(), written, tokens, trained))

        for batch in batches:
            for c, raw, bits, written in zip(*(batch.column(k) for k in ("conv_id", "ids", "mask", "formatted")), strict=True):
                c = c.as_py()
                if state is None or state[0] != c:
                    if state is not None:
                        close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = np.frombuffer(raw.as_py(), np.int32), np.frombuffer(bits.as_py(), bool)
                role, text, under = codec.read(ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if under is not None:
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(written.as_py())
                state[6] += len(ids)
                state[7] += int(mask.sum())
            if len(done) >= 4096:
                yield flush()
        if state is not None:
            close()
        if done:
            yield flush()

    return ordered.mapInArrow(run, READ)


#: The conversation that the query adds: its text looks like control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    vocabulary = load(spark)
    found = read_back(in_order(encode(rows.unionByName(probe), vocabulary)), vocabulary)
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {"op10_chat": op10_chat}


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    pattern = quoted(_ADD.pattern)  # each place gains one character
    size = lambda c: f"length({c}) + len(regexp_extract_all({c}, {pattern}))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', {quoted(PROBE_TEXT)} UNION ALL SELECT {PROBE_ID}, 1, 'assistant', {quoted(PROBE_TEXT)}),
l AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{TRAINED_ROLE}'), '') AS loss,
  CAST(sum({sum(map(len, MARKS))} + {size("role")} + {size("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l"""


ORACLES = {"op10_chat": _sql()}
