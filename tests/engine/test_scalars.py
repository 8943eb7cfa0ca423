import random

from pyspark.sql import functions as F

from tempora.functions import scalars as S
from tempora.operators import ingest as I


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_canonical_and_terms(spark):
    assert one(spark, S.canonical_part(F.lit("  Ümlaut--X 12/é ")) ) == "ümlaut x 12 é"
    assert one(spark, S.lexical_terms(F.lit("The cat, the CAT!"))) == ["the", "cat", "the", "cat"]
    assert one(spark, S.phrase_present(F.lit("a red cat"), F.lit("red"))) and not one(spark, S.phrase_present(F.lit("a redcat"), F.lit("red")))


def test_hash_is_fnv1a(spark):
    assert S.fnv1a64([]) == "cbf29ce484222325"
    h = 0xCBF29CE484222325
    for b in b"ab\xff":
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert S.fnv1a64(["ab"]) == f"{h:016x}"
    assert one(spark, S.stable_hash(F.lit("ab"), F.lit("c"))) == S.fnv1a64(["ab", "c"])
    assert S.fnv1a64(["ab", "c"]) != S.fnv1a64(["a", "bc"])


def test_tokens_and_clip(spark):
    assert one(spark, S.estimate_tokens(F.lit("a b c"))) == 3 and one(spark, S.estimate_tokens(F.lit(""))) == 1 and one(spark, S.estimate_tokens(F.lit("x" * 9))) == 3
    assert S.clip_to_budget("one two three four", 3) == "one two"


def test_dates(spark):
    assert one(spark, S.utc_minute(F.lit(1678406400000))) == "2023-03-10 00:00Z (1678406400000)"
    assert one(spark, S.utc_minute(F.lit(None).cast("long"))) == ""


def test_masking(spark):
    assert one(spark, S.mask_values(F.lit("Al, alice and Alice-Bob, malice"), ["alice", "Alice-Bob", "al"])) == "Al, [forgotten] and [forgotten], malice"


def test_after(spark):
    f = lambda a, s, b, t: one(spark, S.after(F.lit(a), F.lit(s).cast("long"), F.lit(b), F.lit(t).cast("long")))
    assert [f(2, None, 1, None), f(1, 2, 1, 1), f(1, None, 1, 1), f(1, 1, 1, 1)] == [True, True, False, False]


def test_chunks_match_a_loop(spark):
    def loop(text, size, overlap):
        out, start = [], 0
        while text:
            end = min(start + size, len(text))
            out.append((start, end, text[start:end]))
            if end == len(text):
                break
            start = end - overlap if end - overlap > start else end
        return out

    rng = random.Random(1)
    texts = ["", "abcdef", "aé日b"] + ["".join(rng.choices("aé日 ", k=rng.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((3, 1), (2, 0), (10, 3), (7, 6)):
        got = {}
        for r in I.chunk(df, "doc_id", max_chars=size, overlap=overlap).orderBy("source_id", "span_index").collect():
            got.setdefault(r.source_id, []).append((r.char_start, r.char_end, r.text))
            t = texts[r.source_id]
            assert t.encode()[r.byte_start : r.byte_end].decode() == r.text
        assert got == {i: loop(t, size, overlap) for i, t in enumerate(texts) if t}
