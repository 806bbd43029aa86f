"""A vocabulary that drops white space: words with signs and digits are made of known words, a batch asks for each once."""

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from keysift.llm import encoding

FORMS = ["Reeshanth$$$ reeshanth!! «reeshanth» REESHANTH7 reeshanth.%%%", "l'Étéraine (étéraine) étéraine's 1,étéraine's", "reeshanth|étéraine ÉTÉRAINE&&& ,'s 'sx"]
ODD = [None, "", " ", "\n\n", "a\tb  c", "İx, ix", "<|endoftext|> a<|EndOfText|>b", "H̱h é É. Kk ﬁ 中文 Σας", "\x1c '", "x" * 300 + "$1"]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_with_signs_ask_for_the_word_alone(monkeypatch, path):
    tokenizer = Tokenizer.from_file(path)
    own, whole, letters, calls = encoding._Memo._whole, [], encoding._Memo._letters, []
    monkeypatch.setattr(encoding._Memo, "_whole", lambda self, text: whole.append(text) or own(self, text))
    monkeypatch.setattr(encoding._Memo, "_letters", lambda self, part: calls.append(part) or letters(self, part))
    get = encoding.word_level(tokenizer)
    plain = [t.replace("«", "(").replace("»", ")") for t in FORMS]
    for t in plain:
        assert get(t) == b"".join(i.to_bytes(4, "little") for i in ids(tokenizer, t))
    assert not [t for t in whole if "reeshanth" in t.lower() or "étéraine" in t.lower()]
    assert calls.count("reeshanth") == calls.count("étéraine") == 1


@pytest.mark.parametrize("texts", [FORMS, ODD, FORMS + ODD, [None], []])
def test_batches_equal_the_library(monkeypatch, path, texts):
    tokenizer = Tokenizer.from_file(path)
    for memo in (encoding.MEMO, 3):
        monkeypatch.setattr(encoding, "MEMO", memo)
        for run in (encoding.word_batches(tokenizer), encoding.text_batches(encoding.word_level(tokenizer))):
            for column in (pa.array(texts, pa.string()), pa.array(["before", *texts], pa.large_string())[1:]):
                for _ in range(2):
                    edges, found = run(column)
                    assert len(edges) == len(texts) + 1 and edges[0] == 0
                    assert [found[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [ids(tokenizer, t) for t in texts]


def test_added_tokens_inside_words(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(["stop"])
    run = encoding.word_batches(tokenizer)
    texts = ["nonstop stop Stop, stops", "no such word", "s top st op"]
    edges, found = run(pa.array(texts))
    assert [found[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [ids(tokenizer, t) for t in texts]


def test_every_plain_letter_is_its_lower_case(path):
    normalize = Tokenizer.from_file(path).normalizer.normalize_str
    letters = [c for c in map(chr, range(33, 0x250)) if encoding._PLAIN(c)]
    assert len(letters) > 400 and all(normalize(c) == c.lower() for c in letters)
    assert normalize("".join(letters)) == "".join(letters).lower()
