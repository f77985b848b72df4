"""Classes of characters as patterns, by rule."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable


def class_of(test: Callable[[str], object], first: int = 0x80, last: int = 0xFFFF) -> re.Pattern:
    """A pattern for runs of the characters from ``first`` to ``last`` that pass a test."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(first, last + 1) if test(chr(c))) + "]+")


#: Characters of the first plane that are not seen; a class beyond it is searched more slowly.
HIDDEN = class_of(lambda c: unicodedata.category(c) == "Cf")
#: Accents that stand alone after decomposition, without and with the voicing marks of kana.
ACCENT = class_of(lambda c: unicodedata.combining(c) and c not in "゙゚")
HIDDEN_OR_MARK = class_of(lambda c: unicodedata.category(c) == "Cf" or unicodedata.combining(c))
