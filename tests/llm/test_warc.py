import base64
import hashlib
import random
from pathlib import Path

import zstandard

from palaver.llm import warc

from .helpers import pages


def table(spark):
    rng = random.Random(1)
    words = ["<p>alpha</p>", "<p>beta</p>", "<div class=x>", "</div>", "é", "\x00\n\r\n\r\n", warc.EMPTY_FRAME]
    rows = [(i, f"http://h/{i} x", "".join(rng.choices(words, k=rng.randrange(400)))) for i in range(80)]
    rows += [(200 + i, None, "<p>copy</p>") for i in range(30)] + [(300, "u", None), (301, "u", ""), (None, "u", "<p>copy</p>"), (229, "u", "<p>copy</p>")]
    return pages(spark, rows)


def test_round_trip_equals_the_table(spark):
    df = table(spark)
    got = warc.archive(df).collect()
    rows = df.collect()
    last = {}
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", -1), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        first = last[r.html or ""] == r.page_id
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[r.html or ""]))
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))


def test_files_are_frames_led_by_their_dictionary(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(table(spark), path, sample_bytes=2000)
    records = 0
    for file in Path(path).glob("part-*"):
        data = file.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        raw = data[8: 8 + int.from_bytes(data[4:8], "little")]
        found = list(warc.frames(data))
        records += len(found)
        with zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).stream_reader(data, read_across_frames=True) as whole:
            assert whole.read() == b"".join(found)
    assert records == table(spark).count()


def test_small_payloads_are_not_revisits(spark):
    got = warc.archive(table(spark), least=50).collect()
    assert {r.record_type for r in got if r.payload_bytes < 50} == {"response"}


def test_empty_table(spark):
    assert warc.archive(pages(spark, [])).count() == 0
