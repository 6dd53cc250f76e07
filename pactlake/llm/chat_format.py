"""Chat formatting by token-level assembly.

Each segment of a conversation (a role's mark, a text, an end mark) becomes tokens on its own; marks are reserved ids
beyond the tokenizer's vocabulary, so no text can produce them. Control strings that occur in a text get one more
backslash in front, which is taken away on reading back. The loss mask is 1 under the assistant's texts; it is a
prefix sum over +1 and -1 at segment borders.

Turns are ordered by turn, then role, then text, nulls first. A null text or role counts as empty. Repeated rows are
turns of their own. Conversations without rows don't occur; an empty table gives an empty result; extra columns of
the input are left out.

Turns are encoded and read back where they lie, before any shuffle. Digests over a conversation's turns in order are
then hashed from a sorted stream that holds one Arrow batch, however many turns a conversation has. format_chats
returns a whole conversation as one row, so there a conversation must fit in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reserved marks in the order of their ids, from the first id after the vocabulary.
MARKS = ("### System:\n", "### User:\n", "### Assistant:\n", "### Turn:\n", "</role>\n", "\n</turn>\n")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, ROLE_END, TURN_END = 3, 4, 5
#: Control strings as they may occur in texts, with the backslashes before them.
CONTROL = re.compile(r"\\*(?:### (?:System|User|Assistant|Turn):|</role>|</turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[0][0] == "\\" else m[0], text)


class ChatTemplate:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.plain = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 1

    def encode(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, loss mask) of (role, text) turns."""
        parts, borders, at = [], [], 0
        for role, text in turns:
            head = [self.base + ROLES.get(role, OTHER)]
            if role not in ROLES:
                head += [*self.plain.encode_ordinary(escape(role)), self.base + ROLE_END]
            body = self.plain.encode_ordinary(escape(text))
            parts += [head, body, [self.base + TURN_END]]
            if role == "assistant":
                borders += [(at + len(head), 1), (at + len(head) + len(body), -1)]
            at += len(head) + len(body) + 1
        ids = np.fromiter((x for p in parts for x in p), np.int64, at)
        steps = np.zeros(at + 1, np.int64)
        for i, d in borders:
            steps[i] += d
        return ids, np.cumsum(steps)[:-1]

    def render(self, ids: np.ndarray) -> str:
        out, start = [], 0
        for i in np.flatnonzero(ids >= self.base):
            out += [self.plain.decode(ids[start:i].tolist()), MARKS[ids[i] - self.base]]
            start = i + 1
        return "".join(out)

    def read_back(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
        """(turns, texts under the loss mask) from tokens alone."""
        turns, learnt, role, start = [], [], "", 0
        names = {v: k for k, v in ROLES.items()}
        for i in np.flatnonzero(ids >= self.base):
            mark = ids[i] - self.base
            between = ids[start:i]
            if mark == TURN_END:
                turns.append((role, unescape(self.plain.decode(between.tolist()))))
                covered = between[mask[start:i] == 1]
                if mask[start:i].any():
                    learnt.append(unescape(self.plain.decode(covered.tolist())))
            elif mark == ROLE_END:
                role = unescape(self.plain.decode(between.tolist()))
            else:
                role = names.get(int(mark), "")
            start = i + 1
        return turns, learnt


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _vocabulary(df: DataFrame, path: str | None, pattern: str | None) -> tuple:
    import public_tokenizers

    # 50,256 entries: a fixed size. The driver reads the file; executors need no copy of it.
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return ranks, pattern or public_tokenizers.PATTERN


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    for chunk in iter(lambda: list(islice(rows, size)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), schema.types, strict=True)], schema=schema)


def _key_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()


def format_chats(df: DataFrame, tokenizer_path: str | None = None, pattern: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, ids array<int>, mask array<int>, formatted), one row for each conversation."""
    ranks, split = _vocabulary(df, tokenizer_path, pattern)
    kind = df.schema[conv].dataType.simpleString()
    out = pa.schema([("key", _key_type(kind)), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32())), ("formatted", pa.string())])

    def chats(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        template = ChatTemplate(ranks.value, split)
        for key, rows in groupby(_rows(batches), itemgetter(0)):
            turns = [(r or "", t or "") for _, r, t in rows]
            ids, mask = template.encode(turns)
            yield key, len(turns), ids.tolist(), mask.tolist(), template.render(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(chats(batches), out)

    ordered = df.select(conv, role, text, turn).repartition(conv).sortWithinPartitions(conv, turn, role, text).select(conv, role, text)
    return ordered.mapInArrow(run, f"`{conv}` {kind}, n_turns long, ids array<int>, mask array<int>, formatted string")


def read_turns(df: DataFrame, tokenizer_path: str | None = None, pattern: str | None = None, role: str = "role", text: str = "text", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(keys..., role_given, role, text_given, text, learnt, formatted_chars): each turn formatted and read back from
    its tokens, without a shuffle. A turn's tokens end in a mark of their own, so a conversation's tokens are its
    turns' one after the other. learnt: the loss mask covers the text; given: the field wasn't null."""
    ranks, split = _vocabulary(df, tokenizer_path, pattern)
    fields = [df.schema[k] for k in keys]
    made = [("role_given", pa.bool_()), ("role", pa.string()), ("text_given", pa.bool_()), ("text", pa.string()), ("learnt", pa.bool_()), ("formatted_chars", pa.int64())]

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        template = ChatTemplate(ranks.value, split)
        for *key, r, t in _rows(batches):
            ids, mask = template.encode([(r or "", t or "")])
            ((role_back, text_back),), learnt = template.read_back(ids, mask)
            if learnt and learnt != [text_back]:
                raise ValueError("a loss mask that covers a part of a text")
            yield *key, r is not None, role_back, t is not None, text_back, bool(learnt), len(template.render(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            out = pa.schema([*((f"key{i}", first.schema.types[i]) for i in range(len(keys))), *made])
            yield from _packed(turns(chain([first], batches)), out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "role_given boolean, role string, text_given boolean, text string, learnt boolean, formatted_chars long"])
    return df.select(*keys, F.col(role).alias("_role"), F.col(text).alias("_text")).mapInArrow(run, schema)


def chat_digests(df: DataFrame, tokenizer_path: str | None = None, pattern: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the tokens."""
    kind = df.schema[conv].dataType.simpleString()
    out = pa.schema([("key", _key_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, turns in groupby(_rows(batches), itemgetter(0)):
            whole, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, r, t, learnt, c in turns:
                whole.update(f"{r}\n{t}\n".encode())
                n, chars = n + 1, chars + c
                if learnt:
                    loss.update(t.encode())
                    loss_chars += len(t)
            yield key, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(digests(batches), out)

    back = read_turns(df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), role, text), tokenizer_path, pattern, role, text, ("_conv", "_turn"))
    ordered = back.repartition("_conv").sortWithinPartitions("_conv", "_turn", "role_given", "role", "text_given", "text").select("_conv", "role", "text", "learnt", "formatted_chars")
    return ordered.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Conversation -7 of op4: control strings behind a backslash and bare.
PLANTED = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat_digests(table.unionByName(own))


_CTRL = r"### (?:System|User|Assistant|Turn):|</role>|</turn>"
_N = "(len(regexp_extract_all({0}, '" + _CTRL + "')) + length({0}))"
OP4_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PLANTED}', 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}', 'assistant', '{PLANTED}'),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({_N.format("text")} + CASE role WHEN 'system' THEN {len(MARKS[0])} WHEN 'user' THEN {len(MARKS[1])} WHEN 'assistant' THEN {len(MARKS[2])}
        ELSE {len(MARKS[3]) + len(MARKS[4])} + {_N.format("role")} END + {len(MARKS[5])}) AS formatted FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM whole
"""
