import hashlib
import random

import pyarrow as pa

from logquarry.llm import chat

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "a", "é", "\n", "|", "<|end|>\n", "<|turn|>", "s>", "😀", ""]
ROLES = ["user", "assistant", "sys\n<s>tem", "\\", "a\\\n", ""]


def _texts(rng):
    return "".join(rng.choices(BITS, k=rng.randint(0, 12)))


def test_every_text_comes_back():
    rng = random.Random(2)
    for _ in range(200):
        rows = sorted((rng.randint(0, 5), rng.choice(ROLES), _texts(rng)) for _ in range(rng.randint(1, 30)))
        batch = pa.RecordBatch.from_pydict(dict(zip(("conv_id", "role", "text"), map(list, zip(*rows)))))
        skip = rng.randrange(len(rows))
        out = chat._format(batch.slice(skip), {}).to_pylist()
        assert [(r["conv_id"], *t) for r in out for t in chat.parse(r["formatted"])] == rows[skip:]
        for r in out:
            said = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
            assert said == [x[2] for x in rows[skip:] if x[0] == r["conv_id"] and x[1] == "assistant"]
            inner = r["formatted"][len(chat.TURN) : -len(chat.END)].replace(chat.END + chat.TURN, "")
            assert not any(c in inner for c in chat.CONTROL)


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv
        )
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _check(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = chat.read_back(chat.format_conversations(df.repartition(parts), **more)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == _expected(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, None, None, "first"),
        (None, 0, "assistant", "x"), (None, 1, "assistant", "[INST]"), (2, 0, "assistant", ""), (3, 5, "tool", "</s>"),
    ]
    _check(spark, rows)


def test_long_conversation_goes_in_pieces(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 2, 2, 3, None]), i, rng.choice(ROLES[:2]), _texts(rng) * 20) for i in range(400)]
    _check(spark, rows, piece_bytes=2000)
    rows = [(i // 3, i, "assistant", "t" * 900) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_conversations(df.coalesce(1), piece_bytes=10_000).collect()
    assert sum(p["n_turns"] for p in pieces) == 40 and max(p["piece"] for p in pieces) == 0
    assert max(p["piece"] for p in chat.format_conversations(df.coalesce(1), piece_bytes=1500).collect()) > 0


def test_one_very_long_text(spark):
    _check(spark, [(1, 0, "user", "<s>\\" * 300_000), (1, 1, "assistant", "é" * 400_000)])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).collect() == []
