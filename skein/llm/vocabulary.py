"""Where the public vocabulary files are. The folder is a parameter; nothing of it is copied here."""

from __future__ import annotations

import os
from functools import lru_cache


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A file's place in ``folder``, or in the installed package of public tokenizers."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The ``tokenizers`` library's tokenizer without truncation or padding, one thread to a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
