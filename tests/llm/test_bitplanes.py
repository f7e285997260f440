import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeloom.llm import bitplanes as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def want(docs, whole):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for d, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def check(spark, docs, whole):
    got = sorted((tuple(r) for r in B.token_files(spark, docs, PATH).collect()), key=lambda r: r[1])
    assert got == want(docs, whole)


def test_given_tables(spark, sf, whole):
    check(spark, sf("documents"), whole)


def test_odd(spark, odd, none, whole):
    check(spark, odd, whole)
    assert B.token_files(spark, none, PATH).count() == 0


def test_small_chunks_and_files(spark, sf, whole, tmp_path, monkeypatch):
    docs = sf("documents").limit(40)
    rows = [(r.doc_id, list(B.encoder(PATH)([r.text or ""]))[0]) for r in docs.collect()]
    monkeypatch.setattr(B, "CHUNK_IDS", 100)
    with open(tmp_path / "f.bpl", "wb") as out:
        writer = B.FileWriter(out, 3)
        for d, ids in rows:
            writer.add(d, ids)
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f.bpl")) as source:
        reader = B.FileReader(source)
        assert [n for _, n in reader.chunks[:-1]] == [100] * (len(reader.chunks) - 1)
        assert [(d, len(i), zlib.crc32(i.tobytes())) for d, i in rows] == list(reader.documents())
        joined = np.concatenate([i for _, i in rows])
        assert (reader.chunk(3) == joined[300:400]).all()
    (tmp_path / "bad.bpl").write_bytes((tmp_path / "f.bpl").read_bytes()[:-5])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "bad.bpl")) as source, pytest.raises(ValueError):
        B.FileReader(source)


def test_files_are_there(spark, sf, tmp_path):
    manifest = B.write_planes(sf("documents"), PATH, str(tmp_path))
    names = {r.file for r in manifest.collect()}
    assert names and names <= {p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/*.bpl")}


@pytest.mark.parametrize("width", [0, 1, 7, 16, 17, 31])
def test_planes(width):
    rng = np.random.default_rng(width)
    for n in (1, 7, 64, 1000):
        ids = rng.integers(0, 1 << width, n, "u4", endpoint=False) if width else np.zeros(n, "u4")
        planes = B.to_planes(ids)
        assert len(planes) <= width and (B.from_planes(planes, n) == ids).all()


def test_pieces_equal_whole_texts(whole):
    texts = [
        "", " ", "Don't stop, it's I'll we've A'S", "a-b c--d 'quoted' \"x\" 3.14 1,000 x2y", "İstanbul ΣΟΦΟΣ straße ÉTÉ été ́x",
        "<|endoftext|> a<|startoftext|>b <|endoftext|>", "tab\tand\x0bvt\x1cfs\x85nel nbsp em", "中文字 日本語。한국어", "\U0001f600\U0001f601 ok!!! ???", "the%%% of&&& and*** is,$$$",
        "ﬁne ﬀ Ⅷ ² ½ ªº", "a" * 3000 + " " + "ab" * 50 + ".", "x\n\ny \n z\r\nw", "K KELVIN ſ", "ΑΣ. ΑΣ ας Σ", "l'été d'où 's 't 're", "ẞ İ ǅ",
    ]
    encode = B.Encoder(PATH)
    for _ in range(2):
        assert [ids.tolist()[:-1] for ids in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    small = B.Encoder(PATH)
    for t in texts * 2:
        assert next(small([t])).tolist()[:-1] == whole.encode(t, add_special_tokens=False).ids


def test_tokenizer_files_that_do_not_split_at_spaces(sf):
    """Facts that the fast way needs are read from the file; other tokenizers get whole texts."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert B.splits_at_spaces(PATH) == "</w>" and B.splits_at_spaces(other) is None
    texts = [r.text for r in sf("documents").limit(30).collect()]
    own = Tokenizer.from_file(other)
    assert [ids.tolist() for ids in B.Encoder(other)(texts)] == [[*own.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_tables_that_overflow(sf, whole, monkeypatch):
    for name, size in (("PIECES", 300), ("WORDS", 200), ("GROUP_CHARS", 3000), ("REMEMBERED_CHARS", 4)):
        monkeypatch.setattr(B, name, size)
    texts = [r.text for r in sf("documents").limit(40).collect()] + ["A'b <|endoftext|> " + "x" * 90, "ÉÀ é 'll ...", ""]
    assert [ids.tolist() for ids in B.Encoder(PATH)(texts)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_no_word_is_learned_twice(sf, whole, monkeypatch):
    """A group's words are learned once, and none is encoded by itself where the tables overflow."""
    learned, alone = [], []
    learn, each = B.Encoder._learn, B.Encoder._each
    monkeypatch.setattr(B.Encoder, "_learn", lambda self, words: learned.append(words) or learn(self, words))
    monkeypatch.setattr(B.Encoder, "_each", lambda self, texts: alone.extend(texts) or each(self, texts))
    monkeypatch.setattr(B, "WORDS", 300)
    monkeypatch.setattr(B, "GROUP_CHARS", 3000)
    texts = [r.text for r in sf("documents").limit(40).collect()]
    assert [ids.tolist() for ids in B.Encoder(PATH)(texts)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert all(len(words) == len(set(words)) for words in learned) and not [w for w in alone if w.isascii() and w.isalpha()]


def test_latin_pieces_are_told_without_python(whole, monkeypatch):
    """Letters of ASCII and Latin-1 in either case with punctuation behind are words, not encoded by themselves."""
    told, alone = [], []
    plain, each = B._plain, B.Encoder._each
    monkeypatch.setattr(B, "_plain", lambda piece: told.append(piece) or plain(piece))
    monkeypatch.setattr(B.Encoder, "_each", lambda self, texts: alone.extend(texts) or each(self, texts))
    texts = ["Équeai était, là! STRASSE Straße. ÀÿÞß...", " ".join(a + b + c for a in B.LETTERS for b in "aÉ" for c in ("", ",", "'"))]
    assert [ids.tolist() for ids in B.Encoder(PATH)(texts)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert not told and not [p for p in alone if p.strip(B.PUNCTUATION)]


def test_slices_of_arrow_columns(whole, monkeypatch):
    monkeypatch.setattr(B, "GROUP_CHARS", 20)
    texts = ["not this", "Ünder dé 'x", "", "дом Дом. ДОМ, 中文 e\u0301", "a <| b<| <|endoftext|> c " * 3, "", "x" * 50 + " last"]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    encode = B.Encoder(PATH)
    for kind in (pa.string(), pa.large_string()):
        assert [ids.tolist() for ids in encode(pa.array(texts, kind)[1:])] == want[1:]
        assert list(encode(pa.array([], kind))) == []


def test_table_keeps_short_strings_and_begins_anew(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED_CHARS", 3)
    table = B.Table()
    rows, new = table.find(pa.array(["a", "long", "b"], pa.large_string()), 9)
    assert rows.tolist() == [0, 1, 2] and len(new) == 3
    table.add(new, np.array([5, 6, 7, 8], "<u4"), np.array([1, 2, 1]))
    assert [x.tolist() for x in table.of(rows)] == [[5, 6, 7, 8], [1, 2, 1]]
    table.drop_long()
    rows, new = table.find(pa.array(["c", "b", "long"], pa.large_string()), 9)
    assert table.names.to_pylist() == ["a", "b"] and rows.tolist() == [2, 1, 3] and new.to_pylist() == ["c", "long"]
    rows, new = table.find(pa.array(["c", "b"], pa.large_string()), 2)
    assert len(table.names) == 0 and rows.tolist() == [0, 1] and new.to_pylist() == ["c", "b"]
