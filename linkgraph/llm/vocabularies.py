"""Public vocabularies, read inside the task that uses them: token ids and token bytes."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

#: Texts beyond this many characters go to tokenizers itself: the pattern of the rank encoder gives up on some long runs.
LONG = 50_000


def place(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public vocabularies of the machine that asks."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(name: str) -> list[bytes]:
    """Bytes of each id of a byte-level .json vocabulary; added tokens, which plain text never gives, are empty."""
    with open(place(name), encoding="utf-8") as file:
        content = json.load(file)
    added = {t["content"] for t in content["added_tokens"]}
    alphabet, vocabulary = byte_alphabet(), content["model"]["vocab"]
    tokens = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])]))
    for entry, i in vocabulary.items():
        if entry not in added:
            tokens[i] = bytes(alphabet[c] for c in entry)
    return tokens


def byte_level_encoder(name: str, tokens: list[bytes]) -> Callable[[str], list[int]]:
    """Ids of a text, in which the strings of special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    ranks = {t: i for i, t in enumerate(tokens) if t}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) <= LONG:
            return fast.encode_ordinary(text)
        if not slow:
            slow.append(Tokenizer.from_file(place(name)))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def piece_model(name: str):
    """A sentencepiece model and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=place(name))
    tokens = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return model, tokens
