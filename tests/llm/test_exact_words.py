"""Words that simple hashes take for equal, and hashes that all meet."""

import brute
import numpy as np
import pytest
from test_text_operators import BYTE, WORD, by_id, crc, expected_ids

from docweave.llm import near_dup, orc_tokens, packing, substring_dedup, token_counts, words
from docweave.llm.shared import scratch_path
from docweave.llm.tokens import load_tokenizer


def morse(letters, n):
    """The sequence that sums of letters times powers of an odd number can't tell from its complement."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def alike():
    texts, i = {}, 0
    for n in (1024, 2048, 4096):
        for letters in ("ab", "ba"):
            texts[i] = morse(letters, n)
            texts[i + 1] = " ".join(f"w{j}" for j in range(15)) + f" {texts[i]} " + " ".join(f"z{j}" for j in range(15))
            i += 2
    return texts


@pytest.fixture(scope="module")
def alike_docs(spark, alike):
    return spark.createDataFrame(list(alike.items()), "doc_id long, text string").coalesce(1)


def test_words_alike(spark, alike, alike_docs):
    assert by_id(substring_dedup.remove_repeats(alike_docs), "n_words", "n_removed", "kept_sha256") == brute.repeats(alike)
    assert by_id(near_dup.near_duplicates(alike_docs, k=2), "n_shingles", "component_id", "kept") == brute.near(alike, 2)


def test_tokens_alike(spark, alike, alike_docs):
    ids = expected_ids(alike)
    pieces = by_id(packing.pack_documents(alike_docs, WORD), "length", "ids_crc32")
    assert pieces == {d: (len(x), crc(x)) for d, x in ids.items()}
    path = scratch_path(spark, "orc")
    orc_tokens.write_token_orc(alike_docs, path, WORD)
    assert {d: v for d, v in by_id(orc_tokens.token_positions(spark, path), "n_tokens", "ids_crc32").items()} == pieces
    tok = load_tokenizer(BYTE)
    assert by_id(token_counts.count_tokens(alike_docs, BYTE), "n_tokens") == {d: (len(tok.encode(t, add_special_tokens=False).ids),) for d, t in alike.items()}


def test_keys_are_words():
    texts = [b"a b a\0 a\0\0 aa " + b"x" * 15 + b" " + b"x" * 16 + b" " + b"x" * 17 + b" A " + b"x" * 16, None, b"", "é É 漢字漢字漢字".encode()]
    for fold in (False, True):
        own = words.words_of(texts, fold)
        _, where, which = words.distinct(*words.keys(own))
        plain = [w.lower() if fold else w for t in texts for w in (t or b"").split()]
        assert [own.folded[a:b].tobytes() for a, b in zip(own.begin, own.end)] == plain
        assert [plain[i] for i in where[which]] == plain and len(where) == len(set(plain))


def test_equal_codes_of_different_words(monkeypatch):
    monkeypatch.setattr(words, "codes", lambda low, high: np.zeros(len(low), dtype=np.uint64))
    own = words.words_of([b"one two three two one", b"two"])
    _, where, which = words.distinct(*words.keys(own))
    assert len(where) == 3 and which[0] == which[4] and which[1] == which[3] == which[5] and len(set(which.tolist())) == 3


@pytest.mark.parametrize("window", [1, 3, 4, 20])
def test_trees_decide_on_words(window, monkeypatch):
    """All words dealt by one equal hash: trees still mark what plain comparison marks."""
    rng = np.random.default_rng(window)
    texts = [" ".join(rng.choice(["a", "b", "cc"], size=n)).encode() for n in (60, 61, 3, 90, 60)]
    texts.append(texts[1])
    monkeypatch.setattr(substring_dedup, "mix", lambda x: np.zeros(len(x), dtype=np.uint64))
    records = np.zeros(len(texts), dtype=substring_dedup._RECORD)
    records["doc"], records["size"] = np.arange(len(texts)), [len(t) for t in texts]
    records["n"] = [max(0, len(t.split()) - window + 1) for t in texts]
    packed = substring_dedup._packed(records, np.zeros(len(texts), dtype=np.int64), False, texts)
    covered = {i: set() for i in range(len(texts))}
    for batch in substring_dedup._repeats(packed, window, 1):
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "flag", "n", "raw", "payload"))):
            for m in substring_dedup._unpacked(row, substring_dedup._MARK)[0]:
                covered[int(m["doc"])] |= set(range(m["at"], m["at"] + m["n"] + window - 1))
    assert {d: len(c) for d, c in covered.items()} == {d: v[1] for d, v in brute.repeats({i: t.decode() for i, t in enumerate(texts)}, window).items()}
