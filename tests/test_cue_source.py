"""The cue data source against the reader in expressions, in batches and as a stream."""

import random

from cuelake.sources import cue_source, readers

STYLED = "[Events]\nComment: 0,0:00:00.00,0:00:01.00,a,b,0,0,0,,no\nDialogue: 0,0:00:01.50,0:00:02.25,a,b,0,0,0,,{\\i1}Oh{\\i0}\\Nwell, then\nDialogue: 0,0:00:03.00,0:00:04.00,a,b,0,0,0,,{\\p1}m 0 0\nDialogue: broken\n"
PLAIN = "﻿1\r\n00:00:01,5 --> 00:00:02,000\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:03 --> x\r\n\r\n3\r\n01:02:03.4 -->  01:02:04.05 align:start\r\n{x}\r\n\r\n\r\n4\r\n02:03.456 --> 02:04.000\r\nlast one"


def test_files_are_those_of_the_reader(spark, tmp_path):
    rng = random.Random(1)
    files = {"a.srt": PLAIN.encode(), "b.vtt": b"WEBVTT\n\n00:01.000 --> 00:02.000\nhi \xff\xfe you\n", "c.ass": STYLED.encode(), "d.srt": b"", "e.ssa": b"\x00\xff\x00", "sub/f.SRT": b"1\n00:00:01,000 --> 00:00:02,000\nx"}
    for k in range(40):
        files[f"g{k}.srt"] = "".join(f"{i}\n00:00:{i:02d},{rng.randrange(1000)} --> 00:00:{i:02d},999\nline {i}\n\n" for i in range(rng.randrange(8))).encode()
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no cue file")
    cue_source.register(spark)
    got = spark.read.format("cues").option("groupBytes", 500).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 3
    rows = got.collect()
    named = lambda p: p.split(f"{tmp_path}/")[1]
    raw = spark.createDataFrame([(n, d) for n, d in files.items()], "path string, content binary").selectExpr("path", "make_valid_utf8(cast(content as string)) as value")
    styled = raw.value.rlike(r"(?m)^Dialogue:")
    cues = readers.parse_cues(raw.where(~styled)).unionByName(readers.parse_styled(raw.where(styled)))
    assert sorted((named(r[0]), *r[1:5]) for r in rows if r.error is None) == sorted(map(tuple, cues.collect()))
    assert {named(r.item_id) for r in rows if r.error} == {r.item_id for r in readers.cue_errors(raw, cues).collect()} >= {"d.srt", "e.ssa"}


def test_a_stream_takes_each_file_once(spark, tmp_path):
    cue_source.register(spark)
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    seen = set()
    for turn in range(3):
        for k in range(2):
            (folder / f"{turn}-{k}.srt").write_text(f"1\n00:00:0{k},000 --> 00:00:05,000\nturn {turn}")
            seen.add((f"turn {turn}", k * 1000))
        stream = spark.readStream.format("cues").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        rows = [(r.text, r.start_ms) for r in spark.read.parquet(out).collect()]
        assert len(rows) == len(seen) and set(rows) == seen
