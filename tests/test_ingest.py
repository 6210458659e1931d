import hashlib
import json
import random

from loomspan.plans import ingest
from loomspan.sources import transcripts as TR


def test_long_conversations_have_transcripts(spark, tmp_path):
    rng = random.Random(2)
    texts = ["hi", "> a\nb", " x\n", "\n\t", "é \u2028 {}", 'say "yes"\\', "\x85y"]
    rows = [("long", f"m{i:05d}", i, rng.choice(["human", "Assistant ", "AI", "user"]), rng.choice(texts)) for i in range(25_000)]
    rows += [(c, f"{c}{i}", i, "human", "\t\n") for c, n in (("blank", 1_500), ("little", 3)) for i in range(n)]
    rows += [("short", "s1", 1, "ai", "b"), ("short", "s0", 0, "human", "a")]
    # fewer than 1,000 messages, more rows
    rows += [("often", f"o{i}", i, "human" if i % 2 == 0 else "ai", f"t{i}") for i in range(600)] * 2
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conversation_uuid string, message_uuid string, position int, sender string, text string").selectExpr("*", "cast(null as string) created_at").write.parquet(f"{tmp_path}/chat_messages.parquet")
    got = {r.path: (r.format, r.md5) for r in ingest.message_transcripts(spark, str(tmp_path)).collect()}
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted({r[2:3] + r[1:2] + (r[3].strip().lower(), r[4]) for r in rows if r[0] == c})
        kind, said = TR.normalise(json.dumps([{"sender": s, "text": t} for _, _, s, t in own], ensure_ascii=False, separators=(",", ":")), f"{c}.json")
        expected[f"{c}.json"] = (kind, hashlib.md5(said.encode()).hexdigest())
    assert got == expected and len(got) == 5


def test_read_in_order_as_gathered(spark, sf, monkeypatch):
    whole = sorted(map(tuple, ingest.message_transcripts(spark, sf).collect()))
    monkeypatch.setattr(ingest, "GATHERED", 0)
    assert sorted(map(tuple, ingest.message_transcripts(spark, sf).collect())) == whole and len(whole) > 10
