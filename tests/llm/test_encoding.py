"""SentencePiece encoding and Ogg containers: exact round trips and the library itself."""

import hashlib
import random
import struct
import zlib

import pytest

from tessel.llm import ogg_media as O
from tessel.llm.piece_bpe import PieceEncoder, default_model, encode_documents

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(default_model())


def test_ids_are_the_librarys(encoder):
    rng = random.Random(1)
    alphabet = "ab  \n\t▁é漢😀<0x0A>s/the ing\x00 ٣1234"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "the" * 3000, " " * 100, "", "\n", "\n\n a", " \n", "▁", "x" + "　" * 50, "a \nb", "a\n b", " a", "a ", "<s></s><unk>"]
    got = encoder.encode_batch(texts)
    assert [ids for ids, _, _ in got] == encoder.library.encode(texts) and not encoder.unlike
    assert all(joined == ",".join(map(str, ids)) and not unlike for ids, joined, unlike in got)


@pytest.mark.parametrize("text", ["theory of the thing", " theory  of\n theory"])
def test_a_wrong_table_shows(text):
    """Ids come from the agenda alone: with a pair taken out of the table they differ from the library's, and it is told."""
    wrong = PieceEncoder(default_model())
    (ids, _, unlike), whole = wrong.encode_batch([text])[0], wrong.library.encode(text)
    assert ids == whole and unlike == 0
    wrong = PieceEncoder(default_model())
    wrong.keys[1:], wrong.pieces = -2, {p: v for p, v in wrong.pieces.items() if len(p) == 1}
    ids, joined, unlike = wrong.encode_batch([text])[0]
    assert ids != whole and unlike >= 3 and joined == ",".join(map(str, ids)) and wrong.library.decode(ids) == text


def test_agenda_alone(encoder):
    """Arrays, heap and library agree."""
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("theringandofq1é") for _ in range(rng.randint(1, 39))) for _ in range(800)]
    told = [encoder.library.encode(w[1:]) for w in words]
    assert encoder.merge_many(words) == told and [encoder.merge(w) for w in words] == told


def test_memo_forgets(encoder, monkeypatch):
    monkeypatch.setattr("tessel.llm.piece_bpe.MEMO_SEGMENTS", 5)
    small = PieceEncoder(default_model())
    texts = [f"word{i} again word{i % 3}\nline {i}" for i in range(40)]
    assert [small.encode_batch([t])[0][0] for t in texts] == small.library.encode(texts)


def test_documents(docs, empty, fixture_rows, encoder):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(docs).filter("unlike_library = 0").collect())
    expected = []
    for i, t, *_ in fixture_rows:
        ids = encoder.library.encode(t or "")
        expected.append((i is None, i, len(ids), sha(",".join(map(str, ids)).encode()), sha(encoder.library.decode(ids).encode())))
    assert got == sorted(expected)
    assert encode_documents(empty).count() == 0
    row = encode_documents(docs.filter("doc_id = 5"), keep=("doc_id", "k"), with_ids=True).first()
    assert row["k"] == "k" and encoder.library.decode(row["ids"]) == row["decoded"]


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("n", [64, 128, 4000, 4032, 64 * 1000, 255 * 64 * 40])
def test_container_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = O.write_ogg(data)
    head = media[:22] + b"\0\0\0\0" + media[26 : 27 + media[26] + sum(media[27 : 27 + media[26]])]
    assert struct.unpack_from("<I", media, 22)[0] == slow_crc(head)
    box = O.read_ogg(media)
    samples, times = O.sound_of(box)
    assert samples == data and box.bad_pages == box.skipped == 0 and times[-1][1] == n / O.RATE
    assert all(a[1] == b[0] for a, b in zip(times, times[1:])) and all(s.ended and not s.broken for s in box.streams.values())


def test_damage():
    data = random.Random(3).randbytes(64 * 4000)
    media = bytearray(O.write_ogg(data))
    media[len(media) // 2] ^= 1
    box = O.read_ogg(bytes(media))
    assert box.bad_pages == 1 and box.skipped > 0
    with pytest.raises(ValueError, match="differ"):
        O.sound_of(box)
    assert O.read_ogg(b"").streams == {} and O.read_ogg(b"noise" * 9).skipped == 45
    cut = O.read_ogg(O.write_ogg(data)[:-100])
    assert cut.bad_pages == 1


def test_packets_that_end_on_a_boundary():
    page = O.Paginator(7)
    packets = [b"a" * 255, b"", b"b" * 510, b"c" * 254, b"d" * 70_000]
    raw = b"".join([*(x for i, p in enumerate(packets) for x in page.put(p, i)), page.page(last=True)])
    assert [p.data for p in O.read_ogg(raw).streams[7].packets] == packets


def test_ogg_columns(docs, empty, fixture_rows):
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in O.ogg_columns(docs).collect()}
    expected = set()
    for i, t, *_ in fixture_rows:
        p, n = O.padded(t)
        expected.add((i, n, len(p), sha(p), zlib.crc32(p[-64:])))
    assert got == expected and O.ogg_columns(docs).count() == len(fixture_rows) and O.ogg_columns(empty).count() == 0
    # The stored form and what is computed from it, row by row.
    for r in O.ogg_columns(docs).collect():
        t = next(t for i, t, *_ in fixture_rows if i == r["doc_id"])
        media = O.write_ogg(O.padded(t)[0])
        samples, times = O.sound_of(O.read_ogg(media))
        x = [b - 128 for b in samples]
        told = dict(f.split("=") for f in r["feature"].split(";"))
        assert (r["media_bytes"], r["media_sha256"], r["bad_pages"], r["duration_s"]) == (len(media), sha(media), 0, len(samples) / O.RATE)
        assert int(told["pages"]) == media.count(b"OggS\0") and int(told["power"]) == sum(v * v for v in x) // len(x) and int(told["mean"]) == sum(x) * 1000 // len(x)
    media = O.ogg_columns(docs.filter("doc_id = 76"), with_media=True)
    packets = O.parse_media(media).orderBy("serial", "packet").collect()
    sound = [r for r in packets if r["serial"] == O.SOUND][1:]
    assert b"".join(bytes(r["data"]) for r in sound).rstrip(b"\0").decode() == next(t for i, t, *_ in fixture_rows if i == 76) and sound[0]["start_s"] == 0
