"""Character classes in Java's regex syntax that agree with Python's str methods."""

#: str.isspace(): all 29 code points.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Letters as \w without digits and underscore has them: no combining marks.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
DIGIT = r"\p{Nd}"
#: Letters of the Sinhala block, as the inside of a class: vowel signs are marks and no letters.
SINHALA = r"\x{0D85}-\x{0D96}\x{0D9A}-\x{0DB1}\x{0DB3}-\x{0DBB}\x{0DBD}\x{0DC0}-\x{0DC6}"
LATIN = r"[A-Za-z]"
#: Where str.splitlines() breaks.
LINE_BREAK = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    """text as a literal for Java's and RE2's regexes."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&" else c for c in text)
