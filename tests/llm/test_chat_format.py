import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trafficlens.llm import chat_format as c

PIECES = st.lists(st.sampled_from([*c.CONTROLS, "\\", "<", "[", " ", "a", "é", "\n", "s>", "INST]"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TURN]"]),
                          PIECES.map("".join)), max_size=6))
def test_round_trip(turns):
    text = "".join("".join(c.segment(r, t)) for r, t in turns)
    assert c.parse(text) == turns
    tokens = [c.tokenize(c.segment(r, t)) for r, t in turns]
    for (role, t), (ids, a, b) in zip(turns, tokens):
        assert c.unescape(c.detokenize(ids[a:b])) == t
        assert c.detokenize(ids) == "".join(c.segment(role, t))


def _rows(seed, convs=300):
    rng = random.Random(seed)
    rows = []
    for k in range(convs):
        n = 1 if k % 7 == 0 else rng.randint(1, 6)
        for t in range(n):
            # half of all conversations begin alike, a third are the same throughout
            word = "hot" if k % 3 == 0 or (k % 2 == 0 and t < 2) else rng.choice("xyz")
            rows.append((k, t, ["user", "assistant", "system", None][(t + (k % 5 == 0)) % 4], f"{word} é {t}"))
    return rows


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def _run(spark, rows, partitions):
    """The stream's rows and the digests read back from it."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        stream = c.prefix_tree(df).checkpoint()
        read = c.whole_conversations(c.read_back(stream)).collect()
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read}
        assert len(got) == len(read)
        return stream.collect(), got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _check_nodes(out, rows):
    """Every distinct path of turns is emitted exactly once, the stream has no gap, positions count the tokens before."""
    convs = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {tuple(t[:n + 1]) for t in convs.values() for n in range(len(t))}
    nodes = sorted((r for r in out if r["kind"] == "node"), key=lambda r: r["start"])
    assert len(nodes) == len(paths) == len({bytes(r["key"]) for r in nodes})
    ends = {bytes(r["key"]): r["position"] + len(r["tokens"]) for r in nodes}
    at = 0
    for r in nodes:
        assert r["start"] == at
        at += len(r["tokens"])
        above = 0 if r["under"] is None else ends[bytes(r["under"])]
        assert r["position"] == above + sum(x["end"] - x["start"] for x in r["attends"])
        assert all(x["end"] <= r["start"] for x in r["attends"])
    return nodes


def test_tree_and_read_back(spark):
    rows = _rows(1)
    out, got = _run(spark, rows, 13)
    assert got == _expected(rows)
    _check_nodes(out, rows)
    assert any(r["kind"] == "context" for r in out)


def test_conversation_over_partitions_and_blocks(spark, monkeypatch):
    # conversation 0 is a third of all rows; 1 and 2 begin like it, over several blocks; 3 is cut by its tokens
    rows = [(0, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(400)]
    rows += [(1, t, ["user", "assistant"][t % 2], f"turn {t}" if t < 230 else "other") for t in range(300)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(128)]
    rows += [(3, t, "assistant", "long " * 300) for t in range(20)] + _rows(2, 100)[100:]
    rows = [r for i, r in enumerate(rows) if i < 848 or r[0] > 3]
    monkeypatch.setattr(c, "BLOCK_TURNS", 32)
    monkeypatch.setattr(c, "BLOCK_TOKENS", 4000)
    out, got = _run(spark, rows, 11)
    assert got == _expected(rows)
    nodes = _check_nodes(out, rows)
    ends = [r for r in out if r["kind"] == "conversation"]
    assert max(r["first"] for r in ends) >= 384 and any(not r["whole"] for r in ends if r["conv_id"] == 2)
    assert {r["first"] for r in ends if r["conv_id"] == 3} != {0}
    # every block's rows name the row that they continue
    keys = {bytes(r["key"]) for r in ends}
    assert all(bytes(r["under"]) in keys for r in [*nodes, *ends] if r["under"] is not None)
    # the stretches' hashes compose, wherever partitions cut
    stretch = [c.Prefix()] * 3
    for i, d in enumerate((5, 7, 11, 13, 17)):
        stretch[0] = stretch[0].then(d, i)
        part = 1 if i < 2 else 2
        stretch[part] = stretch[part].then(d, i)
    assert stretch[1].join(stretch[2]) == stretch[0]


def test_blocks_split_a_hot_conversation(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS LONG) conv_id", "id turn", "'user' role", "repeat('word ', 20) text")
    cut = c.blocks(df.unionByName(df.selectExpr("1L conv_id", "turn", "role", "text").limit(50))).collect()
    assert max(len(r["texts"]) for r in cut) <= c.BLOCK_TURNS
    assert sum(len(r["texts"]) for r in cut if r["conv_id"] is None) == 20_000
    assert sorted(r["first"] for r in cut if r["conv_id"] is None)[:3] == [0, 1024, 2048]
    assert [r["whole"] for r in cut if r["conv_id"] == 1] == [True]


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 1, "assistant", "x" * 300_000),
            (2, 1, "assistant", None), (2, 0, "tool [TEXT]", "\\[INST]\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("path", "sizes", "roles", "shard", "turns"):
        df = df.withColumn(name, df["text"])
    read = c.read_back(c.prefix_tree(df))
    got = {r["conv_id"]: r for r in read.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("user", ""), ("user", "")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("tool [TEXT]", "\\[INST]\\"), ("assistant", "")]
    done = {r["conv_id"]: r for r in c.whole_conversations(read).collect()}
    assert done[None]["loss_chars"] == 300_000 and done[2]["loss_chars"] == 0 and len(done) == 3
    assert c.whole_conversations(c.read_back(c.prefix_tree(df.limit(0)))).count() == 0


def test_text_ids_and_a_text_beyond_a_block(spark):
    rows = [("a", 0, "user", "x" * (c.BLOCK_TOKENS + 5)), ("a", 1, "assistant", "y"), ("b", 0, "assistant", "z"), ("", 0, "tool", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    done = {r["conv_id"]: r for r in c.whole_conversations(c.read_back(c.prefix_tree(df))).collect()}
    want = _expected(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in done.items()} == want
