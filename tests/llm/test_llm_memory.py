"""What an encoder remembers: a plain word once, whether a sign follows it or not."""

from tokenizers import Tokenizer

import public_tokenizers
from lexspark.llm.tokens import Encoder


def test_a_plain_word_is_remembered_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    code, text = Encoder(path), "uno " + " ".join(f"palabra{'x' * n}, palabra{'x' * n}" for n in range(1, 30)) + "."
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert code.encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
    held = [k.strip() for k in [*code._words, *code._parts]]
    assert sum(k == "palabrax" for k in held) == 1
