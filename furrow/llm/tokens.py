"""Token ids of a byte-level BPE tokenizer whose files are a parameter.

The tokenizer file gives the ids. Texts in Latin-1 go through the rank file of the same vocabulary, which gives
the same ids several times as fast; other texts, for which two libraries might split words differently, go
through the tokenizer file itself. Without a rank file all texts do.
"""

from __future__ import annotations

import base64
import os

_loaded: dict = {}


def encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """A function from a list of texts to a list of id lists; loaded once a Python worker."""
    key = (tokenizer_path, ranks_path, pattern)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(tokenizer_path)
        fast, special = None, {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(texts: list[str]) -> list[list[int]]:
            out = []
            for text in texts:
                if fast is not None and _latin1(text):
                    out.append(fast.encode(text, allowed_special="all"))
                else:
                    out.append(exact.encode(text, add_special_tokens=False).ids)
            return out

        _loaded[key] = encode
    return _loaded[key]


def decoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """A function from a list of ids to their text, by the tokenizer file; loaded once a Python worker."""
    if tokenizer_path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    exact = _loaded[tokenizer_path]
    return lambda ids: exact.decode(ids, skip_special_tokens=False)


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
