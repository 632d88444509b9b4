"""Token files, counts, packing and media against the plain libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eddymesh.llm import ans, media, packing, token_count, tokens
from eddymesh.llm.queries import tokenizer

BYTES, WORDS = (tokenizer(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))
#: White space of all kinds, marks, special strings, letters whose lower case is longer, combining marks.
PARTS = ["foo", "Bar", "baz", "\u0130stanbul", "na\u00efve", "e\u0301", "\u00e9", " ", " ", "  ", "\n", " \n", "\t", "\u00a0", " \u00a0", "\u3000", "\u0085", "\u2003", "\x1c", "\x0b", ",", ".", "!?", "'s", "'ll", "''",
         "<|endoftext|>", "<|startoftext|>", "<|", "123", "4", "\u4e2d\u6587", "\u00df", "\u0149", "\u017f", "\u01c5", "\u03a3", "\u0307", "\U0001f600", "-", "\u2013", "\u200b", "\r\n", "don't", "X"]
ODD = [None, "", " ", "  ", "a  b", " x", "x ", "a\n\nb  c <|endoftext|> d", " <|endoftext|>", "é  à  b　 c", "a   b\t c \n d", "it's 3rd-hand!! ÀÉ ﬁ ß\nNext", "x" * 5000, "Word.\nNext 'tis so,\nand\r\nthen"]
SCHEMA = "doc_id long, text string, source string, start long, part int, length int"


def frame(spark, texts):
    return spark.createDataFrame([(k * 3 if k != 4 else None, t, "s", 7, 1, 2) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def plain(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path, documents):
    texts = [t for _, t in documents] + ODD
    encoder, tokenizer, at = tokens.Encoder(path, kept=100), Tokenizer.from_file(path), 0
    for ids, counts in encoder.encode(pa.array(texts, pa.string())):
        for n, own in zip(counts, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == tokenizer.encode(texts[at] or "", add_special_tokens=False).ids
            at += 1
    assert at == len(texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("made", [["foo bar\nfoo", "foo baz \nfoo"], ["what, a hit!", "foo so \t!"]])
def test_known_units_words_and_marks_are_apart(path, made):
    tokenizer = Tokenizer.from_file(path)
    for texts in (made, made[::-1], [*made, *made]):
        encoder = tokens.Encoder(path)
        for text in texts:
            ids = np.concatenate([i for i, _ in encoder.encode(pa.array([text]))])
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_random_texts_by_one_encoder(path):
    texts, encoder = random_texts(25_000, 5), tokens.Encoder(path)
    want, at = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), 0
    for k in range(0, len(texts), 500):
        for ids, counts in encoder.encode(pa.array(texts[k : k + 500])):
            for own in np.split(ids, np.cumsum(counts)[:-1]):
                assert own.tolist() == want[at].ids, texts[at]
                at += 1
    assert at == len(texts)


def test_random_texts_by_pieces_of_pre_tokens():
    texts, split = random_texts(25_000, 6), token_count.PreTokens(BYTES)
    want = Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    for k in range(0, len(texts), 500):
        codes, first, made = split.coded(pa.array(texts[k : k + 500]))
        pieces = np.array([sum(split.counts(m)) for m in made])
        assert np.add.reduceat(pieces[codes], first).tolist() == [len(e) for e in want[k : k + 500]]


def test_token_files_round_trip(spark):
    docs = frame(spark, [*ODD, "repeated", "repeated"])
    blocks, freq = ans.write_tokens(docs, BYTES)
    got = ans.read_tokens(blocks, freq).collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), want, strict=True):
        ids = [*plain(BYTES, text), 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_block_decodes_from_each_checkpoint_and_notices_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 100_000), 999).astype(np.uint32)
    table = ans.table_of(ans.scaled(np.bincount(ids, minlength=1000)))
    assert int(table.freq.sum()) == 1 << ans.SCALE_BITS
    data = ans.pack_block(ids, [1, None], np.array([60_000, 40_000]), table)
    block = ans.Block(data, table)
    assert block.doc_ids == [1, None] and len(block.marks) > 2
    for k, (step, _, _) in enumerate(block.marks):
        assert (block.ids(k) == ids[step * block.lanes :]).all()
    p = np.bincount(ids) / len(ids)
    assert 4 * len(block.words) < 1.01 * len(ids) * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8
    with pytest.raises(ValueError):
        ans.Block(data[:100] + bytes([data[100] ^ 1]) + data[101:], table)


def test_scaled_keeps_rare_ids():
    freq = ans.scaled(np.array([10**12, 1, 0, 1]), 4)
    assert freq.sum() == 16 and freq[2] == 0 and freq[1] >= 1 and freq[3] >= 1


@pytest.mark.parametrize("head", [0, 5, 1 << 17])
def test_token_counts(spark, head):
    docs = frame(spark, [*ODD, "repeated words repeated", "repeated words repeated"])
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs, BYTES, head).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), len(plain(BYTES, r.text))) for r in docs.collect())


def test_token_counts_of_the_table(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, BYTES, 50).collect()}
    assert got == {d: len(plain(BYTES, t)) for d, t in documents[:]}


def test_packing(spark):
    docs = frame(spark, [*ODD, "word " * 5000, "word " * 2047, "word " * 2048, *["short one"] * 40, *[f"w{k} " * (k * 7) for k in range(60)]])
    rows = packing.pack(docs, WORDS).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    places = {}
    for r in rows:
        ids = [*plain(WORDS, texts[r.doc_id]), 0]
        assert r.start == r.piece * 2048 and r.length == min(2048, len(ids) - r.start) > 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(plain(WORDS, t)) + 1 for t in texts.values())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_plan_covers_any_histogram():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 5000):
        lengths, counts = np.unique(np.minimum(1 + rng.geometric(0.002, n), 2048), return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist()))
        plan, total = packing.solve(histogram), {}
        for number, held in plan:
            assert sum(k * c for k, c in held.items()) <= 2048
            for k, c in held.items():
                total[k] = total.get(k, 0) + number * c
        assert total == histogram
        # No more than first-fit decreasing would take by its proven bound.
        assert sum(number for number, _ in plan) <= 11 / 9 * np.ceil(sum(k * c for k, c in histogram.items()) / 1024) + 1
    assert packing.solve({}) == []


@pytest.mark.parametrize("histogram, fewest", [({1000: 300, 700: 300, 340: 300}, 300), ({1000: 3000, 690: 3000, 350: 3000}, 3000), ({n: 200 for n in range(600, 700)}, 6667)])
def test_configurations_that_leave_room_are_used(histogram, fewest):
    plan, least = packing.planned(histogram)
    assert sum(n for n, _ in plan) == fewest and fewest - 0.01 * fewest <= least <= fewest


def test_plan_is_near_the_bound_of_the_dual():
    lengths, demand = np.unique(np.random.default_rng(4).integers(1, 2049, 20_000), return_counts=True)
    plan, least = packing.planned(dict(zip(lengths.tolist(), demand.tolist())))
    assert sum(n for n, _ in plan) <= 1.01 * least


def test_plan_is_solved_to_the_end():
    rng = np.random.default_rng(7)
    lengths = np.arange(1, 2049)
    demand = rng.integers(1, 9, len(lengths))
    rounds, real = [], packing.knapsack
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "knapsack", lambda at, *rest: rounds.append(set(at[(own := real(at, *rest)) > 0].tolist())) or own)
        plan = packing.solve(dict(zip(lengths.tolist(), demand.tolist())))
    # Each length is in some round's configuration.
    assert set().union(*rounds) == set(lengths.tolist())
    assert sum(n * np.array([k * c for k, c in held.items()]).sum() for n, held in plan) == (lengths * demand).sum()


def test_media_round_trip(spark):
    docs = frame(spark, [*ODD, "y" * 192, "z" * 100_000])
    got = {r.doc_id: r for r in media.describe(media.store_texts(docs), digest=True).collect()}
    for r in docs.collect():
        own = (r.text or "").encode()
        padded = own + b" " * (-len(own) % 192 or (0 if own else 192))
        row, file = got[r.doc_id], media.store(padded)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(own), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (row.media_bytes, row.media_sha256, row.samples, row.duration) == (len(file), hashlib.sha256(file).hexdigest(), len(padded) // 192, len(padded) // 192)
        assert row.error is None and row.codec == "raw " and sum(b - a for a, b in row.key_ranges) == len(padded)


def test_media_of_other_files(spark):
    sizes, data = [5, 7, 11, 3], b"0123456789" * 4
    head = media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 1000, 4000, 0), version=1)
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full(b"stts", struct.pack(">3I", 1, 4, 1000)),
        media.full(b"stss", struct.pack(">3I", 2, 1, 3)),
        media.full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)),
        media.full(b"stsz", struct.pack(">2I4I", 0, 4, *sizes)),
        media.full(b"co64", struct.pack(">I2Q", 2, 8, 20)),
    )
    file = media.box(b"mdat", data) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", stbl))))
    found = media.track(file)
    assert (found.codec, found.timescale, found.duration) == ("avc1", 1000, 4000)
    assert found.ranges() == [(8, 13), (27, 38)]
    rows = spark.createDataFrame([(1, file, "a"), (2, file[:60], "b"), (3, b"", "c"), (4, None, "d"), (5, b"\0" * 40, "e")], "id long, media binary, codec2 string")
    got = {r.id: r for r in media.describe(rows).collect()}
    assert got[1].key_ranges == [[8, 13], [27, 38]] and got[1].codec2 == "a"
    assert all(got[k].error and got[k].codec is None for k in (2, 3, 4, 5))


@pytest.mark.parametrize("bits, coded", [(4, bytes([0x57, 0xB3, 0x20])), (8, bytes([5, 7, 11, 3, 2])), (16, struct.pack(">5H", 5, 7, 11, 3, 2))])
def test_media_with_compact_sizes(bits, coded):
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full(b"stts", struct.pack(">3I", 1, 5, 100)),
        media.full(b"stsc", struct.pack(">4I", 1, 1, 5, 1)),
        media.full(b"stz2", struct.pack(">3xBI", bits, 5), coded),
        media.full(b"stco", struct.pack(">2I", 1, 8)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">4I", 0, 0, 1000, 0), bytes(4))
    found = media.track(media.box(b"mdat", bytes(28)) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl)))))
    assert (found.sizes.tolist(), found.duration, found.ranges()) == ([5, 7, 11, 3, 2], 500, [(8, 36)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    blocks, freq = ans.write_tokens(docs, BYTES)
    assert ans.read_tokens(blocks, freq).count() == 0
    assert token_count.token_counts(docs, BYTES).count() == 0
    assert packing.pack(docs, WORDS).count() == 0
    assert media.describe(media.store_texts(docs)).count() == 0


def test_media_with_audio_first_and_fragments(spark):
    def trak(handler, codec, at, sizes):
        stbl = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(70))),
            media.full(b"stts", struct.pack(">3I", 1, len(sizes), 500)),
            media.full(b"stsc", struct.pack(">4I", 1, 1, len(sizes), 1)),
            media.full(b"stsz", struct.pack(f">2I{len(sizes)}I", 0, len(sizes), *sizes)),
            media.full(b"stco", struct.pack(">2I", 1, at)),
        )
        mdhd, hdlr = media.full(b"mdhd", struct.pack(">4I", 0, 0, 1000, 0), bytes(4)), media.full(b"hdlr", bytes(4), handler, bytes(13))
        return media.box(b"trak", media.box(b"mdia", mdhd, hdlr, media.box(b"minf", stbl)))

    data = media.box(b"mdat", b"0123456789" * 4)
    sound, sight = trak(b"soun", b"mp4a", 8, [5, 5]), trak(b"vide", b"avc1", 18, [7, 8, 9])
    for file in (data + media.box(b"moov", sound, sight), data + media.box(b"moov", sight, sound)):
        found = media.track(file)
        assert (found.codec, found.duration, found.ranges()) == ("avc1", 1500, [(18, 42)])
    assert media.track(data + media.box(b"moov", sound)).codec == "mp4a"
    fragmented = data + media.box(b"moov", sound, sight) + media.box(b"moof", media.box(b"traf", bytes(8)))
    row = media.describe(spark.createDataFrame([(1, fragmented)], "id long, media binary")).first()
    assert "fragments" in row.error and row.codec is None and row.key_ranges is None
