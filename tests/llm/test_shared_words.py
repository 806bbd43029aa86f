"""Forms of one word ask the tokenizer once."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keysift.llm import encoding


@pytest.mark.parametrize(("kind", "name", "asked"), [("word", "word_bpe_49k.json", 1), ("byte", "byte_bpe_50k.json", 2)])
def test_forms_of_a_word_are_worked_out_once(monkeypatch, kind, name, asked):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    own, calls = encoding._Memo._letters, []
    monkeypatch.setattr(encoding._Memo, "_letters", lambda self, piece: calls.append(piece) or own(self, piece))
    get = {"byte": encoding.byte_level, "word": encoding.word_level}[kind](tokenizer)
    text = " andrethrend, andrethrend. Andrethrend, andrethrend Andrethrend"
    forms = [text, "Ächie, ächie. İx, ix Ix. I. . , ,, a,b A.b, ñÑ.", "Cióna, cióna ciÓna."]
    for t in forms:
        want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids)
        assert get(t) == want
    assert sum(c.lower() == "andrethrend" for c in calls) == asked
