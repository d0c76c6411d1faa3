"""Token files and BPE against the tokenizers library, over every document of the smallest table and over odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convlens.llm import bpe, queries, token_files

DATA = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "e", "th", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "İ", "ǅ", "́", "𝒳", "中", "'s", "'", "9", "42", "...", ",", "\x00", "\x01", "\x1c", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|startoftext|>", "A", "ING"]


def odd_texts(n=600):
    pick = random.Random(5)
    some = ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(1, 40))) for _ in range(n)]
    return [None, "", " ", "\n", "a" * 5000, "the " * 3000, "1" * 3000, "�", *some]


def documents(spark, tmp_path, texts):
    rows = [(i * 7 % 1009, t, "x", 3) for i, t in enumerate(texts)] + [(None, "no id", None, None), (5, "again", "x", 1), (5, "again", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [DATA, documents(spark, tmp_path_factory.mktemp("odd"), odd_texts()), documents(spark, tmp_path_factory.mktemp("one"), [])]


def test_bpe_matches_library(spark, folders):
    own = Tokenizer.from_file(BYTE)
    for folder in folders:
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = []
        for i, t in rows:
            ids = own.encode(t or "", add_special_tokens=False).ids
            text = own.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [tuple(r) for r in queries.op7_bpe(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_of_random_letters_matches_library():
    own, lib, pick = bpe.vocabulary(BYTE), Tokenizer.from_file(BYTE), random.Random(1)
    for _ in range(3000):
        word = "".join(pick.choice("aabeinorst" if pick.random() < 0.9 else "zqxé中") for _ in range(pick.randrange(1, 60)))
        ids = own.encode_word(word.encode())
        assert ids == lib.encode(word, add_special_tokens=False).ids
        assert own.decode(np.array(ids)) == word.encode()


def test_token_files_match_library(spark, folders):
    own = Tokenizer.from_file(WORD)
    for folder in folders:
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want, start = [], 0
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids)))
            start += len(ids)
        assert sorted((tuple(r) for r in queries.op1_token_files(spark, folder).collect()), key=lambda r: r[1]) == want


def test_files_are_cut_and_empty_tables_give_none(spark):
    docs = spark.createDataFrame([(i, "some words in a row") for i in range(100)], "doc_id long, text string")
    folder, manifest = token_files.write_token_files(docs, WORD, 2, ids_a_file=32, block=16)
    assert manifest.count() > 10
    got = token_files.read_token_files(spark, folder, manifest).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == [6 * i for i in range(100)]
    folder, manifest = token_files.write_token_files(docs.limit(0), WORD, 2)
    assert token_files.read_token_files(spark, folder, manifest).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 2**32])
def test_blocks_round_trip(top):
    pick = np.random.default_rng(top)
    for n in (0, 1, 1023, 1024, 5000, 70_000):
        ids = np.where(pick.random(n) < 0.95, pick.integers(0, max(1, top // 100 + 1), n), pick.integers(0, top, n)).astype(np.uint32)
        file = token_files.TokenFile(token_files.write_file([1, 2], [n // 3, n], ids))
        assert (file.ids() == ids).all() and list(file.doc_ids) == [1, 2]
        assert (file.ids(n // 3, n) == ids[n // 3 :]).all()
    assert len(token_files.write_file([1], [1024], np.where(np.arange(1024) % 50 == 0, 10**9, np.arange(1024) % 7))) < 800


@pytest.mark.parametrize("change", ["no lower case", "strips", "other cuts"])
def test_other_normalisation_is_left_to_the_library(spark, tmp_path, folders, change):
    """A file that normalises or cuts in another way gives the library's ids too, by the slower way."""
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    if change == "no lower case":
        spec["normalizer"]["normalizers"].pop()
    elif change == "strips":
        spec["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True})
    else:
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+\s?[\p{N}]*|[^\s\p{L}]+"
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert not token_files.cuts_at_white_space(spec) and token_files.cuts_at_white_space(json.load(open(WORD, encoding="utf-8")))
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{folders[1]}/documents.parquet")
    folder, manifest = token_files.write_token_files(docs, path, end_id=2)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder, manifest).collect())
    told = [(r["doc_id"], [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in told)
