import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from wellspring.llm import chat_format, jpeg, media, warc
from wellspring.llm.templates import TURN, TemplateError, compile_template, fold, parse


def render(source, **names):
    return "".join(t for t, learned in compile_template(source, chat_format.FILTERS)(names) if learned is not None)


def test_templates_have_loops_branches_and_filters():
    source = "{% for m in ms %}{{ loop.index }}{% if loop.first %}<{% elif m.k == 'b' and not loop.last %}-{% else %}>{% endif %}{{ m.k | upper }}{% endfor %}!"
    assert render(source, ms=[{"k": "a"}, {"k": "b"}, {"k": "c"}]) == "1<A2-B3>C!"
    assert render("{{ a.b.c }}{{ missing }}{{ 'x' + 'y' + n }}", a={"b": {"c": 1}}, n=2) == "1xy2"
    assert render(r"{{ 'it\'s' }}{{ 'a' != 'b' }}{{ (false or 'z') }}") == "it'sTruez"


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}d{% endif %}e"), chat_format.FILTERS) == [("text", "aBce")]
    assert fold(parse("{% for m in ms %}{{ 'a' + 'b' }}-{% endfor %}"), chat_format.FILTERS) == [("for", "m", "ms", [("text", "ab-")])]


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ f(1) }}", "{{ a['b'] }}", "{% import os %}", "{{ a | open }}", "{% for m in a.b.c d %}{% endfor %}", "{% if a %}", "{{ 'a }}", "{{ }}", "{{ a b }}"])
def test_templates_stay_in_the_sandbox(source):
    with pytest.raises(TemplateError):
        render(source, a={"b": 1}, f=len)


def test_generation_is_marked():
    pieces = list(compile_template("{% for m in ms %}x{% generation %}{{ m.t }}{% endgeneration %}{% endfor %}", {})({"ms": iter([{"t": "y"}])}))
    assert pieces == [("x", False), ("y", True), TURN]


control = st.sampled_from([*chat_format.CONTROL, "\\", "<", "|", ">", "[", "]", "/", "s>", "INST", "\n", "a", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(control, max_size=6).map("".join), st.lists(control, max_size=12).map("".join)), max_size=5))
def test_formatted_turns_read_back(turns):
    text = render(chat_format.TEMPLATE, messages=[{"role": r, "text": t} for r, t in turns])
    assert list(chat_format.read_back(text)) == turns
    assert not any(c in chat_format.escape(t) for _, t in turns for c in chat_format.CONTROL)


@pytest.mark.parametrize("part", [1 << 20, 10])
def test_conversations_keep_turns_and_loss(spark, part):
    rng = random.Random(2)
    rows = [(k % 40, k // 40, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "</s>[INST] ok [/INST]", "hello\\", "é" * 50]), k) for k in range(400)]
    rows += [(None, 0, "assistant", "x", 0), (None, None, "user", "y", 0), (3, 0, rows[3][2], rows[3][3], 0), (900, 1, "assistant", "z" * 100_000, 0)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(frame, part_chars=part)).collect()}
    order = lambda v: (v is not None, v)
    held = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (order(r[0]), order(r[1]), order(r[2]), order(r[3]))):
        held.setdefault(c, []).append((role or "", text or ""))
    assert set(found) == set(held)
    for c, turns in held.items():
        r, said = found[c], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(frame.where("false"))).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_payloads_come_back_from_their_images(texts):
    payloads = [media.padded(t) for t in texts]
    assert [p for _, _, p in media.load(media.store(payloads))] == payloads


def plain_decode(image):
    """A bit-by-bit decoder of one grey or colour scan, for comparison."""
    codes = {}
    for key, table in image.tables.items():
        code, k, found = 0, 16, {}
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                found[length, code] = table[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes[key] = found
    data, at = bytearray(), 0
    segments = []
    while True:
        if image.scan[at] == 255 and image.scan[at + 1]:
            segments.append(bytes(data))
            data = bytearray()
            if not 0xD0 <= image.scan[at + 1] <= 0xD7:
                break
            at += 2
            continue
        data.append(image.scan[at])
        at += 1 + (image.scan[at] == 255)
    blocks, total, mcu = [], image.units[0] * image.units[1], image.mcu
    for s, segment in enumerate(segments):
        bits = "".join(f"{b:08b}" for b in segment)
        pos, last = 0, {}

        def symbol(table):
            nonlocal pos
            for length in range(1, 17):
                if (length, int(bits[pos : pos + length], 2)) in table:
                    pos += length
                    return table[length, int(bits[pos - length : pos], 2)]
            raise AssertionError

        def value(size):
            nonlocal pos
            v = int(bits[pos : pos + size] or "0", 2)
            pos += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(image.interval or total, total - (image.interval or 0) * s)):
            for c in mcu:
                dc, ac = (codes[k, image.components[c][4 + k]] for k in (0, 1))
                block = [0] * 64
                last[c] = block[0] = last.get(c, 0) + value(symbol(dc))
                k = 1
                while k < 64:
                    s2 = symbol(ac)
                    if s2 == 0:
                        break
                    k += s2 >> 4
                    if s2 & 15:
                        block[k] = value(s2 & 15)
                    k += 1
                blocks.append(block)
    return np.array(blocks)


def colour_image(rng, interval):
    """A small image of three components, the first sampled two by two, with runs of zeros, written bit by bit."""
    lengths = {0: 3, 1: 3, 2: 3, 3: 4, 0x11: 5, 0xF0: 5, 0x32: 6, 0x03: 6}
    symbols, bits = sorted(lengths, key=lambda s: (lengths[s], s)), [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    table, code, codes, n = bytes(bits) + bytes(symbols), 0, {}, 0
    for s in symbols:
        code <<= lengths[s] - n
        codes[s], n = f"{code:0{lengths[s]}b}", lengths[s]
        code += 1
    put = lambda v, size: f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""
    out, down, across = b"", 2, 3
    for unit in range(down * across):
        bits = "" if unit % (interval or 999) == 0 else bits
        for _ in range(6):
            size = rng.randint(0, 3)
            bits += codes[size] + put(rng.choice([-1, 1]) * ((1 << size) - 1), size)
            k = 1
            while k < 64:
                s = rng.choice([0, 1, 2, 3, 0x11, 0xF0, 0x32])
                if s == 0 or k + (s >> 4) > 62:
                    bits += codes[0]
                    break
                bits += codes[s] + put((1 << (s & 15)) - 1 if s & 15 else 0, s & 15)
                k += (s >> 4) + 1
        if interval and unit % interval == interval - 1 or unit == down * across - 1:
            whole = bits + "1" * (-len(bits) % 8)
            out += bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\0")
            if unit < down * across - 1:
                out += bytes((255, 0xD0 + unit // interval % 8))
    seg = lambda m, b: bytes((255, m)) + struct.pack(">H", len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xC4, b"\0" + table + b"\x10" + table)
    return head + (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + out + b"\xff\xd9"


def test_the_decoder_equals_a_plain_one():
    rng = random.Random(4)
    images = [jpeg.parse(colour_image(rng, interval)) for interval in (0, 1, 2, 4) for _ in range(3)]
    for image, blocks in zip(images, jpeg.decode(images), strict=True):
        assert (blocks == plain_decode(image)).all()
        assert jpeg.thumbnail(image, blocks).shape == (4, 5)
    grey = jpeg.parse(media.store([bytes(range(256)) * 3])[0])
    (blocks,) = jpeg.decode([grey])
    assert (blocks == plain_decode(grey)).all()
    assert (jpeg.thumbnail(grey, blocks).ravel()[:12] == np.clip(128 + blocks[:12, 0], 0, 255)).all()


def test_progressive_images_are_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0")


def test_media_columns(documents):
    rows = [(1, None), (2, ""), (3, "é" * 33), (4, "x" * 200_000), (5, "é" * 33), (None, "a")]
    found = {(r.doc_id, r.payload_sha256): r for r in media.media_columns(documents(rows)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = found[i, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(data), len(payload), zlib.crc32(payload[-64:]), len(r.media))
        assert io.BytesIO(r.media).read(2) == b"\xff\xd8" and r.width % 8 == 0
    assert media.media_columns(documents(rows).where("false")).collect() == []


def test_warc_audit_finds_each_fault(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{'x' * (k * 37 % 900)}é</p>") for k in range(600)] + [(None, None, None), (5, "http://a/5", "again")], "page_id bigint, url string, html string")
    made = warc.records(pages, per_archive=100).cache()
    assert made.count() == 602
    back = warc.split_archives(warc.archives(made))
    columns = ["archive", "seq", "offset", "length", "record"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, made.select(columns).collect()))
    levels = warc.depth(made, 4)
    own = warc.tree(made, 4, levels)
    assert warc.audit(own, warc.tree(back, 4, levels), levels, 4).collect() == []
    bad = back.where("not (archive = 3 and seq >= 98) and archive <> 5").selectExpr("archive", "seq", "offset", "length", "case when archive = 1 and seq in (7, 55) then cast('changed' as binary) else record end as record")
    found = {(r.archive, r.seq): (r.status, r.first, r.end) for r in warc.audit(own, warc.tree(bad, 4, levels), levels, 4).collect()}
    lost = {(3, 98), (3, 99), *((5, k) for k in range(100))}
    assert {k for k, v in found.items() if v[0] == "corrupt"} == {(1, 7), (1, 55)} and {k for k, v in found.items() if v[0] == "missing"} == lost
    row = made.where("archive = 1 and seq = 7").first()
    assert found[1, 7][1:] == (row.offset, row.offset + row.length)
    swapped = warc.audit(warc.tree(bad, 4, levels), own, levels, 4)
    assert {(r.archive, r.seq) for r in swapped.where("status = 'extra'").collect()} == lost
    assert warc.tree(warc.records(pages.where("false"))).collect() == []


def test_a_lost_record_is_one_difference_and_files_read_back(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"<p>{'x' * (k * 37 % 900)}é\n\r\n\r\n</p>") for k in range(300)] + [(7, "u", "same")] * 3 + [(400, "long", "y" * 30_000)]
    made = warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string"), per_archive=100).cache()
    warc.write_archives(made, str(tmp_path / "warc"), segment_bytes=9_000)
    back = warc.read_archives(spark, str(tmp_path / "warc"))
    columns = ["archive", "seq", "offset", "length", "record"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, made.select(columns).collect()))
    heads = [bytes(r.record).split(b"\r\n\r\n")[0] for r in made.collect()]
    assert all(b"WARC-Date: " in h and b"WARC-Record-ID: <urn:uuid:" in h for h in heads) and len(set(heads)) == len(rows)
    levels = warc.depth(made, 4)
    own = warc.tree(made, 4, levels)
    # Without its record, a replica counts its places on from the next one.
    lost = back.where("not (archive = 1 and seq = 30)").withColumn("seq", F.expr("if(archive = 1 and seq > 30, seq - 1, seq)"))
    found = warc.audit(own, warc.tree(warc.aligned(lost, made), 4, levels), levels, 4).collect()
    assert [(r.archive, r.seq) for r in found if r.status == "missing"] == [(1, 30)] and {r.status for r in found} <= {"missing", "moved"}
    more = lost.unionByName(lost.where("archive = 2 and seq = 3").withColumn("record_id", F.lit("other")))
    found = warc.audit(own, warc.tree(warc.aligned(more, made), 4, levels), levels, 4).collect()
    assert {(r.archive, r.status) for r in found} == {(1, "missing"), (2, "extra")} and len(found) == 2


def test_doubled_and_moved_records_are_found(spark):
    made = warc.records(spark.createDataFrame([(k, f"http://a/{k}", "x" * (k * 37 % 900)) for k in range(300)], "page_id bigint, url string, html string"), per_archive=100).cache()
    levels = warc.depth(made, 4)
    own = warc.tree(made, 4, levels)
    rows = [r.asDict() for r in made.select("archive", "seq", "length", "record").orderBy("archive", "seq").collect()]

    def audited(change):
        out = []
        for archive in range(3):
            held, at = change(archive, [r for r in rows if r["archive"] == archive]), 0
            for seq, r in enumerate(held):
                out.append((archive, seq, at, r["length"], r["record"]))
                at += r["length"]
        sent = spark.createDataFrame(out, "archive bigint, seq bigint, offset bigint, length bigint, record binary")
        replica = warc.aligned(warc.split_archives(warc.archives(sent)), made)
        return {(r.archive, r.seq): (r.status, r.first, r.end) for r in warc.audit(own, warc.tree(replica, 4, levels), levels, 4).collect()}

    assert audited(lambda a, x: x) == {}
    # A record once more at the end is one too many, and shifts nothing.
    end = sum(r["length"] for r in rows if r["archive"] == 1)
    assert audited(lambda a, x: x + [x[7]] if a == 1 else x) == {(1, 200): ("extra", end, end + rows[107]["length"])}
    # Once more in the middle, the first stays and all that follows has moved.
    found = audited(lambda a, x: x[:50] + [x[7]] + x[50:] if a == 1 else x)
    assert {k for k, v in found.items() if v[0] == "extra"} == {(1, 150)} and {k for k, v in found.items() if v[0] == "moved"} == {(1, k) for k in range(50, 100)}
    swapped = audited(lambda a, x: [x[1], x[0], *x[2:]] if a == 2 else x)
    assert {k: v[0] for k, v in swapped.items()} == {(2, 0): "moved", (2, 1): "moved"}
    first = made.where("archive = 2 and seq = 1").first()
    assert swapped[2, 1][1:] == (first.offset, first.offset + first.length)


def test_warc_archives_are_cut_into_segments(spark):
    rows = [(7, "http://a/7", "same" * 20)] * 120 + [(7, f"http://a/{k}", "x" * (k * 31 % 400)) for k in range(200)] + [(k, "http://b", "y" * k) for k in range(20)] + [(300, "http://c", "z" * 9000), (None, None, None)]
    made = warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string"), large_bytes=20_000).cache()
    assert made.count() == len(rows)
    plain = sorted(map(tuple, made.select("archive", "seq", "offset", "length", "record").collect()))
    ends = {}
    for archive, seq, offset, length, record in plain:
        assert (seq, offset) == ends.get(archive, (0, 0)) and length == len(record)
        ends[archive] = (seq + 1, offset + length)
    ids = [42 if r.id is None else r.id for r in made.where("archive = 0").orderBy("seq").collect()]
    assert ids == sorted(ids) and len(ids) == 341
    held = warc.archives(made, segment_bytes=2_000).cache()
    assert max(len(r.content) for r in held.where("archive = 0").collect()) < 2_000 + 600
    assert sorted(map(tuple, warc.split_archives(held).select("archive", "seq", "offset", "length", "record").collect())) == plain
