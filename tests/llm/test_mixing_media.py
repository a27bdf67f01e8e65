import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strider.llm import media, mixing


def fill(sizes, weights, budget, cap):
    """Rounds of clamping and resharing."""
    target, free, left = {}, set(sizes), budget * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if weights[s] * level >= cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_water_filling_and_taken(spark, seed):
    rnd = random.Random(seed)
    sources = ["a", "b", "Z", "é", None, "dd"]
    share = rnd.choices([1, 3, 10, 60], k=6)
    rows = [(i, rnd.choices(sources, share)[0], rnd.choice([0, 1, 5, 40, 900])) for i in range(800)] + [(1, "a", 7), (1, "a", 7), (None, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash")).repartition(5)
    got = mixing.mix(df).collect()
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in {x for _, x, _ in rows}}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, mixing.BUDGET, mixing.MAX_EPOCHS)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-5) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(2)).collect())) == sorted(map(str, got))


def test_sizes_and_empty(spark):
    df = spark.createDataFrame([(1, "s", None), (2, "s", ""), (3, None, " a\tb\x0bc  d\u00a0e ")], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["size"] for r in mixing.sized(df).collect()} == {1: 0, 2: 0, 3: 4}
    assert mixing.mix(mixing.sized(df.limit(0))).count() == 0
    assert [r["taken"] for r in mixing.mix(mixing.sized(df.where("doc_id < 3"))).collect()] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1020, 1021, 1022, 50_000])
def test_streams_round_trip(n):
    payload = media.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) > 0
    data = media.pack(payload)
    s = media.parse(data)
    assert (s.payload, s.bad_crc, s.resyncs) == (payload, 0, 0)
    assert s.table["frames"] == len(s.offsets) and s.table["bytes"] == len(data) - s.offsets[0] + media.frame_length(5, 0, 0)
    assert s.samples == 1152 * len(s.offsets) and s.duration_us == s.samples * 1_000_000 // 44100
    assert len(s.table["toc"]) == 100 and list(s.table["toc"]) == sorted(s.table["toc"])


def test_damage_is_found():
    data = media.pack(media.padded(b"\xff\xfa\x90\xc0" * 2000))
    s = media.parse(data)
    assert len(s.offsets) > 5
    junk = media.parse(data[: s.offsets[2]] + b"\xff\xfb junk \xff" + data[s.offsets[2] :])
    # no intact frame is lost, before the damage or after it
    assert junk.resyncs == 1 and len(junk.offsets) == len(s.offsets) and (junk.payload, junk.samples) == (s.payload, s.samples)
    for text in (b"TAG ", b"ID3\x04\0\0\0\0\1\0", b"ID3\3\0\0\0\0\0\0", b"APETAGEX", b"\xff\xfa\xe0\xc0"):
        assert media.parse(data[: s.offsets[3]] + b"junk" + text + data[s.offsets[3] :]).payload == s.payload
    cut = media.parse(data[:-10])
    assert len(cut.offsets) == len(s.offsets) - 1
    flipped = bytearray(data)
    flipped[s.offsets[1] + 10] ^= 1  # in the side information
    assert media.parse(bytes(flipped)).bad_crc == 1
    assert media.parse(b"").payload == b"" and media.parse(b"\xff" * 500).offsets == []
    assert media.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_media_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 40_000), (3, "é" * 40_000)], "doc_id long, text string").withColumn("media", F.lit(0))
    got = sorted(media.described(media.stored(df)).collect())
    assert [(r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in got] == [(1, 0, 64), (2, 0, 64), (3, 80_000, 80_000), (3, 80_000, 80_000)]
    assert got[2] == got[3] and got[0][3:] == got[1][3:]
    assert media.described(media.stored(df.limit(0))).count() == 0


def test_seek_offsets_and_exact_duration_are_returned(spark):
    both = media.stored(spark.createDataFrame([(1, None), (2, "é" * 40_000)], "doc_id long, text string"))
    streams = {r["doc_id"]: bytes(r["media"]) for r in both.collect()}
    described = media.described(both.unionByName(spark.createDataFrame([(3, 0, b"")], both.schema)))
    got = {r["doc_id"]: r for r in described.withColumn("feature", media.features()).collect()}
    for i, data in [*streams.items(), (3, b"")]:
        s = media.parse(data)
        assert (got[i]["offsets"], got[i]["samples"], got[i]["rate"]) == (s.offsets, s.samples, s.rate)
        seek = hashlib.md5(b"".join(x.to_bytes(8, "big") for x in s.offsets)).hexdigest()
        assert got[i]["feature"] == f"frames={len(s.offsets)};samples={s.samples};us={s.duration_us};bad_crc=0;resyncs=0;vbr_frames={s.table.get('frames', 0)};vbr_bytes={s.table.get('bytes', 0)};seek={seek}"
    assert len(got[2]["offsets"]) > 5 and all(streams[2][x : x + 2] == b"\xff\xfa" for x in got[2]["offsets"])


def stream(word, n=5, body=b"\x55", crc=None):
    """n frames with the header `word`, filled with `body`."""
    head = media._head(word)
    frame = word + (crc or b"") + (body * head.length)[: head.length - 4 - len(crc or b"")]
    return frame * n, head


# version, layer and index bits; kbit/s, rate, samples, bytes of a frame by hand
@pytest.mark.parametrize("word,kbit,rate,samples,length", [
    (b"\xff\xfb\x90\xc0", 128, 44100, 1152, 417), (b"\xff\xfb\x92\xc0", 128, 44100, 1152, 418), (b"\xff\xf3\x80\xc0", 64, 22050, 576, 208), (b"\xff\xe3\x18\xc0", 8, 8000, 576, 72),
    (b"\xff\xfd\xa4\x00", 192, 48000, 1152, 576), (b"\xff\xf5\x88\xc0", 64, 16000, 1152, 576), (b"\xff\xff\xc0\x00", 384, 44100, 384, 416), (b"\xff\xf7\x44\xc0", 64, 24000, 384, 128), (b"\xff\xff\xc2\x00", 384, 44100, 384, 420),
])
def test_versions_and_layers(word, kbit, rate, samples, length):
    data, head = stream(word)
    assert (head.kbit, head.rate, head.samples, head.length) == (kbit, rate, samples, length)
    s = media.parse(b"\0\0junk" + data)
    assert s.offsets == [6 + k * length for k in range(5)] and (s.samples, s.rate, s.resyncs) == (5 * samples, rate, 1)
    assert media.parse(data).duration_us == 5 * samples * 1_000_000 // rate


def bitwise_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


def bits_of(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


@pytest.mark.parametrize("word,covered", [
    (b"\xff\xfe\xc0\x00", 256),  # Layer I, stereo: 4 bits for each of 32 subbands and 2 channels
    (b"\xff\xfe\xc0\xc0", 128), (b"\xff\xfe\xc0\x50", 4 * (16 + 24)),  # mono; joint from subband 8
    (b"\xff\xfc\x14\xc0", 2 * 4 + 6 * 3 + 2 * 8),  # Layer II, 32 kbit/s mono at 48 kHz: 8 subbands, all used
    (b"\xff\xfc\xa4\xc0", 11 * 4 + 12 * 3 + 4 * 2 + 2 * 27), (b"\xff\xfc\xa0\x00", 2 * (11 * 4 + 12 * 3 + 7 * 2 + 2 * 30)), (b"\xff\xf4\x80\xc0", 4 * 4 + 7 * 3 + 19 * 2 + 2 * 30),
    (b"\xff\xfa\x90\x00", 32 * 8), (b"\xff\xf2\x80\xc0", 9 * 8),
])
def test_checksums_of_all_layers(word, covered):
    body = b"\xff" * 3000  # every allocation is used
    head = media._head(word)
    assert media.protected_bits(word + b"\0\0" + body, 0, head) == covered
    crc = bitwise_crc(bits_of(word[2:]) + bits_of(body)[:covered])
    data, _ = stream(word, body=b"\xff", crc=crc.to_bytes(2, "big"))
    assert (media.parse(data).bad_crc, len(media.parse(data).offsets)) == (0, 5)
    wrong, _ = stream(word, body=b"\xff", crc=(crc ^ 1).to_bytes(2, "big"))
    assert media.parse(wrong).bad_crc == 5


def test_tags_of_all_versions():
    audio, _ = stream(b"\xff\xfb\x90\xc0")
    plain = lambda n: n.to_bytes(4, "big")
    safe = lambda n: bytes(n >> k & 127 for k in (21, 14, 7, 0))
    text = b"c" * 300
    v23 = b"COMM" + plain(300) + b"\0\0" + text + b"TIT2" + plain(2) + b"\0\0" + b"hi"
    v24 = b"TIT2" + safe(300) + b"\0\0" + text + b"TPE1" + safe(4) + b"\0\2" + b"a\xff\0b" + b"TALB" + safe(6) + b"\0\1" + safe(2) + b"xy"
    v22 = b"TT2" + (5).to_bytes(3, "big") + b"title"
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (8 + 7 + 3 + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1 << 31 | 1 << 29).to_bytes(4, "little") + bytes(8)
    ape += (3).to_bytes(4, "little") + bytes(4) + b"Artist\0" + b"xyz"
    ape += b"APETAGEX" + (2000).to_bytes(4, "little") + (50).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1 << 31).to_bytes(4, "little") + bytes(8)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(30) + b"\x07"
    tag = lambda v, body, flags=0: b"ID3" + bytes((v, 0, flags)) + safe(len(body)) + body
    s = media.parse(tag(3, v23) + audio)
    assert s.tags == {"COMM": [text], "TIT2": [b"hi"]} and len(s.offsets) == 5 and s.resyncs == 0
    s = media.parse(tag(4, v24, 0x10) + b"3DI\4\0\x10" + safe(len(v24)) + audio)
    assert s.tags == {"TIT2": [text], "TPE1": [b"a\xffb"], "TALB": [b"xy"]} and (len(s.offsets), s.resyncs) == (5, 0)
    assert media.parse(tag(2, v22) + audio).tags == {"TT2": [b"title"]}
    unsynced = (b"TIT2" + plain(3) + b"\0\0" + b"a\xffb").replace(b"\xff", b"\xff\0")
    assert media.parse(tag(3, unsynced, 0x80) + audio).tags == {"TIT2": [b"a\xffb"]}
    assert media.parse(tag(3, plain(6) + bytes(6) + v23, 0x40) + audio).tags["TIT2"] == [b"hi"]
    assert media.parse(tag(4, safe(6) + b"\1\0" + v24, 0x40) + audio).tags["TALB"] == [b"xy"]
    s = media.parse(audio + ape + v1)
    assert s.tags["ape.Artist"] == [b"xyz"] and s.tags["v1.title"] == [b"Song"] and s.tags["v1.genre"] == [b"\x07"] and (len(s.offsets), s.resyncs) == (5, 0)


def test_tables():
    word = b"\xff\xfb\x90\x00"
    audio, head = stream(word)
    vbri = (word + bytes(32) + b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (2500).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes((0, 2, 0, 10, 0, 2, 0, 3)) + bytes((0, 100, 1, 0))).ljust(head.length, b"\0")
    s = media.parse(vbri + audio)
    assert s.table == {"kind": "VBRI", "frames": 5, "bytes": 2500, "quality": 75, "toc": [1000, 2560], "frames_per_entry": 3} and len(s.offsets) == 5
    info = (word + bytes(32) + b"Info" + bytes((0, 0, 0, 9)) + (5).to_bytes(4, "big") + (90).to_bytes(4, "big")).ljust(head.length, b"\0")
    assert media.parse(info + audio).table == {"kind": "Info", "frames": 5, "quality": 90}


def test_any_bytes_are_parsed():
    rnd = random.Random(11)
    for _ in range(300):
        data = b"".join(rnd.choice((b"ID3", b"TAG", b"APETAGEX", b"\xff\xfb\x90\x64", b"\xff\xfd", b"Xing", b"VBRI", rnd.randbytes(rnd.randint(0, 600)))) for _ in range(12))
        s = media.parse(data)
        assert s.offsets == sorted(set(s.offsets)) and len(s.payload) <= len(data)
