import json
from datetime import datetime

from archlens.streaming.changes import language_counts


def test_languages_by_window(spark, tmp_path):
    rows = [("a.py", "x\n", "2024-01-01 00:10:00"), ("b.py", "x\ny\n", "2024-01-01 00:50:00"), ("c.ts", "", "2024-01-01 01:10:00"), ("node_modules/d.ts", "x\n", "2024-01-01 01:10:00"), ("none", "x\n", "2024-01-01 01:10:00")]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "text", "ts"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("path string, text string, ts timestamp").json(str(source))
    out = language_counts(stream).writeStream.format("memory").queryName("languages").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {(r.window.start, r.lang, r.files, r.loc) for r in spark.table("languages").collect()}
    assert got == {(datetime(2024, 1, 1, 0), "Python", 2, 3), (datetime(2024, 1, 1, 1), "TypeScript", 1, 0)}
