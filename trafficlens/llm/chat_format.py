"""Chat formatting as a prefix tree.

Each turn becomes a segment of a template; control strings inside texts are
escaped reversibly.  Conversations that begin with the same turns share those
segments: every distinct path of turns is one node, its tokens are emitted
once, in depth-first order, with the position id its first token has in its
conversations and the intervals of earlier tokens (its ancestors) that it
attends to.

A turn's key is a hash of all turns up to it, H = H * FACTOR + digest modulo
a prime, so the hashes of two stretches compose: turns are range partitioned
in conversation order, each partition gives one summary of its last
conversation's stretch, the driver composes these (one row per partition), and
a second pass numbers the turns.  A conversation may thus cross any number of
partitions.  It is then cut into blocks of at most BLOCK_TURNS turns and about
BLOCK_TOKENS tokens, at places that depend on the turns before alone, so equal
beginnings are cut alike and merge in every block.

A block's path is the keys of its turns, so sorting by path is a depth-first
order of the tree, and a range partitioning by (path, conv_id) splits it
anywhere, also inside a very common first turn.  Two passes over the sorted,
checkpointed blocks: the first gives one summary per partition (its last path,
at most a block's, and how many tokens it adds), the driver adds these up (one
row per partition), the second emits.  A partition that begins inside an older
subtree repeats the shared nodes as ``context`` rows, not counted as emitted,
so each can be read alone.  A conversation's blocks after the first are trees
of their own, tied to what they continue by ``under``.

Tokens are UTF-8 bytes (0-255) and one id from 256 for each control string.

Rows of a conversation are ordered by turn (nulls first), then role, then
text; repeated rows are turns of their own.  A null role or text counts as
empty; rows with a null conv_id are one conversation.  An empty table gives
an empty result.  Roles other than user, assistant and system are kept in
the segment.  No row holds more than a block and one turn.  A digest over a
whole conversation is sequential by its definition: `whole_conversations`
streams the blocks of a long conversation through one task, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import map_rows, prepare, table
from trafficlens.llm.registry import register

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[TEXT]", "[/TURN]")
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLES = {a: (role, b) for role, (a, b) in MARKS.items()}
ID = {c: 256 + i for i, c in enumerate(CONTROLS)}

_ANY = "|".join(re.escape(c) for c in CONTROLS)
INSIDE = re.compile(rf"(\\*)({_ANY})")
ESCAPED = re.compile(rf"\\(\\*)({_ANY})")
REAL = re.compile(rf"(?<!\\)({_ANY})")
PATH_BYTES = 16
PRIME = (1 << 127) - 1
FACTOR = 0x5851F42D4C957F2D14057B7EF767814F
BLOCK_TURNS = 1024
BLOCK_TOKENS = 1 << 20
RANGE_CHARS = 64  # of a text, to place range bounds between turns that tie in number and role


def escape(text: str) -> str:
    """One more backslash before each control string (and the backslashes that stand before it)."""
    return INSIDE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def segment(role: str, text: str) -> list[str]:
    """The turn's parts, control strings and escaped texts in turn.

    Spaces keep texts apart from the control strings around them, so a text
    that ends in a backslash escapes nothing.
    """
    if role in MARKS:
        a, b = MARKS[role]
        return [a, f" {escape(text)} ", b]
    return ["[TURN]", f" {escape(role)} ", "[TEXT]", f" {escape(text)} ", "[/TURN]"]


def tokenize(parts: list[str]) -> tuple[np.ndarray, int, int]:
    """Token ids of a segment, and the tokens [from, to) of its text."""
    out, at, span = [], 0, (0, 0)
    for p in parts:
        if p in ID:
            ids = np.array([ID[p]], np.int16)
        else:
            ids = np.frombuffer(p.encode(), np.uint8).astype(np.int16)
            span = (at + 1, at + len(ids) - 1)  # within the spaces; the last such part is the text
        out.append(ids)
        at += len(ids)
    return np.concatenate(out), *span


def detokenize(tokens: np.ndarray) -> str:
    """The formatted text of a stretch of tokens."""
    special = np.flatnonzero(tokens > 255)
    out, at = [], 0
    for i in special.tolist():
        out += [tokens[at:i].astype(np.uint8).tobytes().decode(), CONTROLS[tokens[i] - 256]]
        at = i + 1
    out.append(tokens[at:].astype(np.uint8).tobytes().decode())
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    parts = REAL.split(formatted)
    out, i = [], 1
    while i < len(parts):
        if parts[i] == "[TURN]":
            role, text, i = unescape(parts[i + 1][1:-1]), unescape(parts[i + 3][1:-1]), i + 6
        else:
            role, text, i = ROLES[parts[i]][0], unescape(parts[i + 1][1:-1]), i + 4
        out.append((role, text))
    return out


class Node(NamedTuple):
    """A segment at a place in the tree's depth-first token stream."""
    key: bytes
    start: int
    size: int
    position: int
    ancestors: tuple[tuple[int, int], ...]

    def below(self) -> tuple[tuple[int, int], ...]:
        """The intervals that a child attends to: this node's and its own, joined where they touch."""
        a = self.ancestors
        if a and a[-1][1] == self.start:
            return (*a[:-1], (a[-1][0], self.start + self.size))
        return (*a, (self.start, self.start + self.size))


def split_path(path: bytes) -> list[bytes]:
    return [path[i:i + PATH_BYTES] for i in range(0, len(path), PATH_BYTES)]


def shared(stack: list[Node], path: list[bytes]) -> int:
    n = 0
    while n < len(stack) and n < len(path) and stack[n].key == path[n]:
        n += 1
    return n


def push(stack: list[Node], path: list[bytes], sizes: list[int], offset: int, base: int) -> int:
    """Replaces the stack's end by the path's nodes below the shared ones; the offset behind them.

    base: the position of the path's first token.
    """
    n = shared(stack, path)
    del stack[n:]
    for key, size in zip(path[n:], sizes[n:]):
        up = stack[-1] if stack else None
        stack.append(Node(key, offset, size, up.position + up.size if up else base, up.below() if up else ()))
        offset += size
    return offset


class Prefix(NamedTuple):
    """What the turns before a place in a conversation add up to."""
    turns: int = 0
    tokens: int = 0
    hash: int = 0

    def then(self, digest: int, size: int) -> Prefix:
        return Prefix(self.turns + 1, self.tokens + size, (self.hash * FACTOR + digest) % PRIME)

    def join(self, later: Prefix) -> Prefix:
        """This stretch and a later one, which was added up from nothing."""
        return Prefix(self.turns + later.turns, self.tokens + later.tokens,
                      (self.hash * pow(FACTOR, later.turns, PRIME) + later.hash) % PRIME)

    def key(self) -> bytes:
        return self.hash.to_bytes(PATH_BYTES, "big")


def _digests(batches: Iterator[dict]) -> Iterator[dict]:
    """Of each turn, by itself: a digest and its segment's token count."""
    for cols in batches:
        digests, sizes = [], []
        for role, text in zip(cols["role"].to_pylist(), cols["text"].to_pylist()):
            r = role.encode()
            digests.append(hashlib.blake2b(b"%d %s%s" % (len(r), r, text.encode()), digest_size=PATH_BYTES).digest())
            sizes.append(sum(1 if p in ID else len(p.encode()) for p in segment(role, text)))
        yield {"digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64())}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in conversation order: its first and last conversation and the last one's turns in it."""
    first = last = shard = conv_type = None
    at, one = Prefix(), True
    for b in batches:
        conv_type = b["conv_id"].type
        for shard_id, conv, digest, size in zip(*(b[c].to_pylist() for c in ("shard", "conv_id", "digest", "size"))):
            if shard is None:
                shard, first, last = shard_id, conv, conv
            elif conv != last:
                last, at, one = conv, Prefix(), False
            at = at.then(int.from_bytes(digest, "big"), size)
    if shard is not None:
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "first": pa.array([first], conv_type),
            "last": pa.array([last], conv_type), "one": pa.array([one]), "turns": pa.array([at.turns], pa.int64()),
            "tokens": pa.array([at.tokens], pa.int64()), "hash": pa.array([at.key()], pa.binary())})


def _before(stretches: list) -> dict[int, Prefix]:
    """What the first conversation of each partition has in earlier partitions."""
    out: dict[int, Prefix] = {}
    last, carry = None, Prefix()
    for s in sorted(stretches, key=lambda r: r["shard"]):
        own = Prefix(s["turns"], s["tokens"], int.from_bytes(s["hash"], "big"))
        out[s["shard"]] = carry if s["first"] == last else Prefix()
        carry = out[s["shard"]].join(own) if s["one"] else own
        last = s["last"]
    return out


def blocks(turns: DataFrame) -> DataFrame:
    """Conversations cut into blocks.

    Columns: conv_id, first (number of the block's first turn), base (tokens
    before it), under (key of the turn before it), whole (the block is surely
    all of its conversation), roles, texts, path and sizes (token counts).
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    ordered = (plain.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    # digests behind the shuffle: what samples the range bounds does not make them
    rows = map_rows(ordered, {"role": "role", "text": "text"}, _digests, "digest binary, size long",
                    keep=["conv_id", "role", "text"]).checkpoint()
    rows = rows.withColumn("shard", F.spark_partition_id())
    schema = f"shard int, first {conv_type}, last {conv_type}, one boolean, turns long, tokens long, hash binary"
    before = _before(rows.select("shard", "conv_id", "digest", "size").mapInArrow(_stretches, schema).collect())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun = None, Prefix(), False
        for b in batches:
            made: dict[str, list] = {"index": [], "before": [], "under": [], "key": []}
            for shard, conv, digest, size in zip(*(b[c].to_pylist() for c in ("shard", "conv_id", "digest", "size"))):
                if not begun:
                    begun, last, at = True, conv, before[shard]
                elif conv != last:
                    last, at = conv, Prefix()
                up, at = at, at.then(int.from_bytes(digest, "big"), size)
                for k, v in zip(made, (up.turns, up.tokens, up.key(), at.key())):
                    made[k].append(v)
            kept = [b[c] for c in ("conv_id", "role", "text", "size")]
            new = [pa.array(v, pa.int64() if k in ("index", "before") else pa.binary()) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([*kept, *new], ["conv_id", "role", "text", "size", *made])

    numbered = rows.mapInArrow(number, f"conv_id {conv_type}, role string, text string, size long, "
                                       "index long, before long, under binary, key binary")
    turn = F.struct("index", "before", "under", "key", "size", "role", "text")
    cut = numbered.groupBy("conv_id", F.expr(f"index div {BLOCK_TURNS}").alias("_i"),
                           F.expr(f"before div {BLOCK_TOKENS}").alias("_t")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    end = F.col("turns")[F.size("turns") - 1]
    whole = ((F.col("first") == 0) & (end["index"] + 1 < BLOCK_TURNS) & (end["before"] + end["size"] < BLOCK_TOKENS))
    return cut.withColumn("first", F.col("turns")[0]["index"]).select(
        "conv_id", "first", F.col("turns")[0]["before"].alias("base"),
        F.when(F.col("first") > 0, F.col("turns")[0]["under"]).alias("under"), whole.alias("whole"),
        F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"), F.col("turns.key").alias("keys"),
        F.col("turns.size").alias("sizes")).withColumn(
        "path", F.aggregate("keys", F.lit(b""), lambda a, k: F.concat(a, k))).drop("keys")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: the first path, the nodes of the last path (local starts), the tokens it would add alone."""
    stack: list[Node] = []
    first, offset, shard = None, 0, None
    for b in batches:
        for s, p, sizes, base in zip(*(b[c].to_pylist() for c in ("shard", "path", "sizes", "base"))):
            path = split_path(p)
            first, shard = p if first is None else first, s
            offset = push(stack, path, sizes, offset, base)
    if first is not None:
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.binary()),
            "keys": pa.array([b"".join(n.key for n in stack)], pa.binary()),
            "starts": pa.array([[n.start for n in stack]], pa.list_(pa.int64())),
            "sizes": pa.array([[n.size for n in stack]], pa.list_(pa.int64())), "total": pa.array([offset], pa.int64()),
            "base": pa.array([stack[0].position], pa.int64())})


SUMMARY = "shard int, first binary, keys binary, starts array<long>, sizes array<long>, total long, base long"


def _begin(summaries: list) -> dict[int, tuple[int, list[Node]]]:
    """Where each partition begins: its first new token's place, and the older nodes that its first path shares."""
    out, stack, offset = {}, [], 0
    for s in sorted(summaries, key=lambda r: r["shard"]):
        old = stack[:shared(stack, split_path(bytes(s["first"])))]
        known = sum(n.size for n in old)  # the partition alone places these first
        out[s["shard"]] = (offset, old)
        stack = []
        for key, start, size in zip(split_path(bytes(s["keys"])), s["starts"], s["sizes"]):
            up = stack[-1] if stack else None
            if len(stack) < len(old) and start < known and old[len(stack)].key == key:
                stack.append(old[len(stack)])
            else:
                stack.append(Node(key, offset + start - known, size, up.position + up.size if up else s["base"],
                                  up.below() if up else ()))
        offset += s["total"] - known
    return out


INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
OUT_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("position", pa.int64()),
    ("attends", pa.list_(INTERVAL)), ("loss", pa.list_(INTERVAL)), ("tokens", pa.list_(pa.int16())),
    ("key", pa.binary()), ("under", pa.binary()), ("first", pa.int64()), ("whole", pa.bool_())])


def prefix_tree(turns: DataFrame) -> DataFrame:
    """The tree's depth-first stream, in (shard, seq) order.

    kind ``node``: a segment's tokens, emitted once, at [start, start + its
    tokens); position: the id of its first token (they count up); attends:
    its ancestors' intervals in the stream (besides its own tokens, causally);
    loss: the stream intervals under the loss mask (assistant texts).
    kind ``context``: an older partition's node that this partition's first
    rows hang below.  kind ``conversation``: a block that ends at the node at
    ``start`` and consists of the intervals ``attends``; conv_id, first (number
    of its first turn) and whole (surely all of its conversation) are set.
    key: hash of a row's last turn and all before it.  under: null, or the key
    of the turn that the row's tree continues; its rows attend besides to all
    that the ``conversation`` row of that key consists of, and so on upwards.
    """
    prepare(turns.sparkSession)
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (blocks(turns).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
            .checkpoint())
    rows = rows.withColumn("shard", F.spark_partition_id())
    begin = _begin(rows.select("shard", "path", "sizes", "base").mapInArrow(_summaries, SUMMARY).collect())
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Node] | None = None
        offset = seq = 0
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in OUT_SCHEMA} | {"conv_id": []}

            def row(kind, node, attends, loss=(), tokens=None, first=None, whole=None, conv_id=None):
                nonlocal seq
                seq += 1
                spans = [[{"start": a, "end": e} for a, e in x] for x in (attends, loss)]
                for k, v in zip(out, (shard, seq, kind, node.start, node.position, *spans, tokens,
                                      node.key, under, first, whole, conv_id)):
                    out[k].append(v)

            def node_row(kind, node, role, text):
                tokens, a, e = tokenize(segment(role, text))
                loss = ((node.start + a, node.start + e),) if role == "assistant" and e > a else ()
                row(kind, node, node.ancestors, loss, tokens)

            for conv_id, p, sizes, roles, texts, shard, base, under, first, whole in zip(*(b[c].to_pylist() for c in (
                    "conv_id", "path", "sizes", "roles", "texts", "shard", "base", "under", "first", "whole"))):
                path = split_path(p)
                if stack is None:
                    offset, old = begin[shard]
                    stack = list(old)
                    for node, role, text in zip(old, roles, texts):
                        node_row("context", node, role, text)
                old = shared(stack, path)
                offset = push(stack, path, sizes, offset, base)
                for node, role, text in zip(stack[old:], roles[old:], texts[old:]):
                    node_row("node", node, role, text)
                row("conversation", stack[-1], stack[-1].below(), first=first, whole=whole, conv_id=conv_id)
            conv = pa.array(out.pop("conv_id"), b["conv_id"].type)
            made = [pa.array(v, OUT_SCHEMA.field(k).type) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([*made, conv], [*OUT_SCHEMA.names, "conv_id"])

    return rows.mapInArrow(emit, "shard int, seq long, kind string, start long, position long, "
                                 "attends array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, "
                                 "tokens array<short>, key binary, under binary, first long, whole boolean, "
                                 f"conv_id {conv_type}")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
READ_TYPES = {"first": pa.int64(), "whole": pa.bool_(), "turns": pa.list_(TURN), "loss": pa.string(),
              "formatted_chars": pa.int64()}


def read_back(stream: DataFrame) -> DataFrame:
    """Every block of a ``prefix_tree`` stream (partitions whole and in order), from its tokens alone.

    Columns: conv_id, first, whole, turns (role, text), loss (the text under
    the loss mask), formatted_chars.
    """
    conv_type = stream.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int, np.ndarray, list]] = []  # start, end, tokens, loss intervals
        shard = None

        def keep(attends):
            """Leaves the nodes that the intervals cover; those of one path come in increasing order."""
            while stack and not any(x["start"] <= stack[-1][0] and stack[-1][1] <= x["end"] for x in attends[::-1]):
                stack.pop()

        for b in batches:
            kinds, starts, attends, losses, shards, convs, firsts, wholes = (b[c].to_pylist() for c in (
                "kind", "start", "attends", "loss", "shard", "conv_id", "first", "whole"))
            flat, ends = b["tokens"].values.to_numpy(), b["tokens"].offsets.to_numpy()
            out: dict[str, list] = {"conv_id": [], **{k: [] for k in READ_TYPES}}
            for i, kind in enumerate(kinds):
                if shards[i] != shard:
                    shard = shards[i]
                    stack.clear()
                keep(attends[i])
                if kind != "conversation":
                    tokens = flat[ends[i]:ends[i + 1]].copy()
                    stack.append((starts[i], starts[i] + len(tokens), tokens, losses[i]))
                    continue
                formatted = detokenize(np.concatenate([s[2] for s in stack]))
                loss = "".join(unescape(detokenize(t[x["start"] - a:x["end"] - a])) for a, _, t, l in stack for x in l)
                turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                for k, v in zip(out, (convs[i], firsts[i], wholes[i], turns, loss, len(formatted))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, READ_TYPES.get(k, b["conv_id"].type)) for k, v in out.items()], list(out))

    return stream.mapInArrow(run, f"conv_id {conv_type}, first long, whole boolean, "
                                  "turns array<struct<role:string,text:string>>, loss string, formatted_chars long")


class Digests:
    """Counts and digests of a conversation, added up block by block."""

    def __init__(self):
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: list[dict], loss: str, formatted_chars: int) -> Digests:
        for t in turns:
            self.whole.update(f"{t['role']}\n{t['text']}\n".encode())
        self.loss.update(loss.encode())
        self.turns += len(turns)
        self.loss_chars += len(loss)
        self.formatted_chars += formatted_chars
        return self

    def row(self) -> tuple:
        return self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def whole_conversations(read: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: conv_id and DIGESTS.

    A block that is a whole conversation gives its row where it is; of the
    others the texts are shuffled, and stream through in order.
    """
    conv_type = read.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def one(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            wholes, turns, losses, chars = (cols[c].to_pylist() for c in ("whole", "turns", "loss", "formatted_chars"))
            rows = [Digests().add(t, x, n).row() if w else (None,) * len(names)
                    for w, t, x, n in zip(wholes, turns, losses, chars)]
            done = {k: pa.array(v, kind) for k, v, kind in zip(names, zip(*rows), kinds)}
            yield {"turns": pa.array([None if w else t for w, t in zip(wholes, turns)], READ_TYPES["turns"]),
                   "loss": pa.array([None if w else x for w, x in zip(wholes, losses)], pa.string()),
                   "chars": cols["formatted_chars"], **done}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, conv_type_ = None, None, None

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate([conv_type_, *kinds])], ["conv_id", *names])

        for b in batches:
            rows, conv_type_ = [], b["conv_id"].type
            ready = list(zip(*(b[c].to_pylist() for c in names)))
            for i, (c, w) in enumerate(zip(b["conv_id"].to_pylist(), b["whole"].to_pylist())):
                if w:
                    rows.append((c, *ready[i]))
                    continue
                if open_ is not None and c != conv:
                    rows.append((conv, *open_.row()))
                    open_ = None
                conv, open_ = c, (open_ or Digests()).add(*(b[x][i].as_py() for x in ("turns", "loss", "chars")))
            yield out(rows)
        if open_ is not None:
            yield out([(conv, *open_.row())])

    needs = {c: c for c in ("whole", "turns", "loss", "formatted_chars")}
    schema = f"turns array<struct<role:string,text:string>>, loss string, chars long, {DIGESTS}"
    rows = map_rows(read, needs, one, schema, keep=["conv_id", "first", "whole"])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(
        fold, f"conv_id {conv_type}, {DIGESTS}")


_SQL_ANY = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[TURN\]|\[TEXT\]|\[/TURN\]"


@register("op1_chat_format", oracle=rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\*)({_SQL_ANY})', '\\\1\2', 'g')) AS n,
             length(regexp_replace(role, '(\\*)({_SQL_ANY})', '\\\1\2', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 2 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE r + 21 END)
       AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    return whole_conversations(read_back(prefix_tree(turns.unionByName(extra))))
