import pytest
from pyspark.sql import functions as F

from driftmatch.operators.engine import Engine, Replacer
from driftmatch.plans.spec import Limits
from driftmatch.sources.windows import cut_window, read_windows, windows_of_texts
from driftmatch.streaming import stream

NEEDLE = {"limits": Limits(edits=1), "case_insensitive": True}
E = Engine(["needle"], **NEEDLE)
BIG = "".join("the quick brown fox " * 7 + ("needle " if k % 3 else "neeedle é ") for k in range(400))


def whole(text):
    return [(m.start, m.end) for m in E.search_local(text, 0.8, "default", "non_overlapping")]


@pytest.mark.parametrize("text", [BIG, "", "x", "é" * 5000 + "needle", "é" * 3000 + " needle " + "\U0001f44d\U0001f3fd" * 500])
@pytest.mark.parametrize("window", [64, 1000, 1 << 18])
def test_windows_cover_the_text(text, window):
    raw, at = text.encode(), 0
    for seq in range(max(1, -(-len(raw) // window))):
        base, part, commit = cut_window(lambda s, e: raw[s:e], len(raw), seq, window, 8)
        assert base == at and raw[base : base + len(part.encode())] == part.encode()
        at += commit
    assert at == len(raw)


def test_search_equals_whole_search(spark):
    df = spark.createDataFrame([("a", BIG), ("b", ""), ("c", None)], "stream_id string, text string")
    w = windows_of_texts(df, E, window=4096)
    got = sorted((r.start, r.end) for r in stream.search_windows(E, w, 0.8).collect())
    assert got == whole(BIG) and len(got) == 400
    assert sorted((r.start, r.end) for r in stream.stream_matches(E, w, 0.8)) == got
    assert {r.stream_id: r.bytes for r in stream.bytes_read(w).collect()} == {"a": len(BIG.encode()), "b": 0, "c": 0}


@pytest.mark.parametrize("text,out", [("a needle b", "a X b"), ("needle b", "X b"), ("a needle", "a X"), ("needle needle", "X X"), ("a neeedle b", "a X b"), ("nothing here", "nothing here"), ("", "")])
def test_replace_small(spark, text, out):
    w = windows_of_texts(spark.createDataFrame([("s", text)], "stream_id string, text string"), E, window=1 << 18)
    r = stream.replace_windows(E, w, lambda m: F.lit("X"), 0.8)
    assert "".join(x.text for x in r.orderBy("seq").collect()) == out
    assert stream.bytes_written(r).first().bytes == len(out.encode())


def test_replace_equals_whole_replace(spark):
    df = spark.createDataFrame([("s", BIG)], "stream_id string, text string")
    r = Replacer([("needle", "<0>")], **NEEDLE)
    want = df.select(r.replace("text", 0.8).alias("t")).first().t
    got = stream.replace_stream(r, windows_of_texts(df, r.engine, window=512), 0.8)
    assert "".join(x.text for x in got.orderBy("seq").collect()) == want
    keep = stream.replace_windows(E, windows_of_texts(df, E, window=512), lambda m: F.lit(None), 0.8)
    assert "".join(x.text for x in keep.orderBy("seq").collect()) == BIG


def test_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text(BIG)
    w = read_windows(spark, f"file://{tmp_path}", E, window=8192)
    assert sorted((r.start, r.end) for r in stream.search_windows(E, w, 0.8).collect()) == whole(BIG)
    assert stream.bytes_read(w).first().bytes == len(BIG.encode())


def test_invalid_bytes_are_an_error(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"needle \xff\xfe needle")
    with pytest.raises(Exception, match="decode"):
        read_windows(spark, f"file://{tmp_path}", E).collect()


def test_structured_streaming(spark, tmp_path):
    text = BIG[:9000]
    cuts = list(range(0, len(text), 700)) + [len(text)]
    rows = [("s", k, text[a:b], b == len(text)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    schema = "stream_id string, seq bigint, text string, last boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 5 : part * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.search_chunks(E, source, 0.8).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start, r.end) for r in spark.table("found").collect()) == whole(text)


def test_callbacks_and_files_of_output(spark, tmp_path):
    w = windows_of_texts(spark.createDataFrame([("s", BIG)], "stream_id string, text string"), E, window=4096)
    seen = []
    assert stream.search_stream(E, w, lambda m: seen.append((m.start, m.end)), 0.8) == len(BIG.encode())
    assert sorted(seen) == whole(BIG)
    stream.write_replaced(stream.replace_windows(E, w, lambda m: F.lit(None), 0.8), str(tmp_path / "out"))
    assert "".join(r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()) == BIG
