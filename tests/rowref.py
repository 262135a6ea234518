"""What one row must give, written as plain Python. Only the tests use this."""

import base64
import codecs
import html
import random
import re
import unicodedata
from urllib.parse import unquote

CONTROL_KEEP = "\n\r\t "


def clean(text, max_length=3000, decode=False, nfkc=False):
    if not text:
        return text
    if decode:
        for _ in range(4):
            again = unquote(html.unescape(text))
            if again == text:
                break
            text = again
    text = re.sub("[\u200b-\u200f\ufeff\u2060-\u2064]", "", text)
    text = re.sub("(?is)<script[^>]*>.*?</script>", "", text)
    text = re.sub("(?is)<style[^>]*>.*?</style>", "", text)
    text = re.sub("<[^>]+>", "", text)
    text = re.sub(r"(?i)display\s*:\s*none[^;]*;?", "", text)
    text = re.sub(r"(?i)font-size\s*:\s*0[^;]*;?", "", text)
    text = re.sub(
        r"(?i)color\s*:\s*(?:white|#fff(?:fff)?|rgb\(255,\s*255,\s*255\))[^;]*;?", "", text
    )
    text = "".join(
        c for c in text if c in CONTROL_KEEP or unicodedata.category(c) not in ("Cc", "Cf")
    )
    text = re.sub("[\ufe00-\ufe0f\U000e0100-\U000e01ef\U000e0001-\U000e007f]", "", text)
    if nfkc:
        text = unicodedata.normalize("NFKC", text)
    text = re.sub(" +", " ", text)
    text = re.sub("\n{3,}", "\n\n", text)
    return (text[:max_length] if max_length else text).strip()


def windows(text, model_max):
    size = max(8, model_max - 2)
    overlap = min(64, size // 4)
    tokens = text.split()
    if len(tokens) <= size:
        return [text]
    out, at = [], 0
    while True:
        out.append(" ".join(tokens[at : at + size]))
        if at + size >= len(tokens):
            return out
        at += size - overlap


def leak_kind(text, token):
    gap = "[\\s.\\-_]{0,3}"
    tests = (
        ("exact", token in text),
        ("casefold", token.lower() in text.lower()),
        ("base64", base64.b64encode(token.encode()).decode() in text),
        ("hex", token.encode().hex() in text.lower()),
        ("reversed", token[::-1] in text),
        ("spaced", re.search(gap.join(map(re.escape, token)), text) is not None),
    )
    return next((name for name, hit in tests if hit), None)


# pieces that make random texts likely to touch every rule
PIECES = (
    "hello", " ", "  ", "\n", "\n\n\n", "\t", "<b>", "</b>", "<", ">", "<script>", "</SCRIPT >",
    "</script>", "<STYLE x>", "</style>", "display:none;", "Font-Size : 0px", "color:#fff", ";",
    "color: white", "\u200b", "\ufeff", "\u202e", "\u2066", "\ufe0f", "\U000e0041", "\U000e0101",
    "\x00", "\x07", "\x85", "\xa0", "\xad", "\u3000", "é", "ß", "漢字", "\U0001f600", "&lt;", "%3C",
    "&amp;lt;", "%25", "100%", "ﬁ", "Ⅷ", " ", "ſ", "=", "-", "_", ".",
)


def random_texts(n, seed=7, pieces=PIECES, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(n)]


from siftgate.functions.decoding import SPAN  # noqa: E402
from siftgate.options import DecodeOptions  # noqa: E402

_SPAN = re.compile(SPAN)
_LIMITS = DecodeOptions(base64=True)


def read_span(span: str) -> tuple[str, str | None]:
    core = span.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(core) % 4 == 1:
        return "", "decode_failed"
    raw = base64.b64decode(core + "=" * (-len(core) % 4))
    if len(raw) < _LIMITS.min_bytes:
        return "", "too_short"
    text = raw.decode("utf-8", "replace")
    good = sum(ch != "\ufffd" and (ch.isprintable() or ch in "\n\r\t") for ch in text)
    if good / len(text) < _LIMITS.min_printable:
        return "", f"low_printable_ratio:{good / len(text):.2f}"
    return text, None


def walk(text: str, decode_base64: bool):
    """Yield ``(label, text, depth, skipped, skip_reason)`` in discovery order."""
    yield "original", text, 0, False, None
    seen, budget = {text}, _LIMITS.candidate_cap
    level = [("", text)]
    for depth in range(1, _LIMITS.max_depth + 1):
        following = []
        for parent, source in level:
            rotated = codecs.encode(source, "rot13")
            tried = [("rot13", rotated, None)] if rotated != source else []
            for m in _SPAN.finditer(source) if decode_base64 else ():
                if budget:
                    budget -= 1
                    tried.append((f"base64@{m.start()}:{m.end()}", *read_span(m.group())))
                else:
                    tried.append((f"base64@{m.start()}:{m.end()}", "", "candidate_cap"))
            for name, found, reason in tried:
                label = f"{parent}/{name}" if parent else name
                if reason is None and found:
                    following.append((label, found))
                if reason is not None or found not in seen:
                    yield label, found, depth, reason is not None, reason
                if reason is None:
                    seen.add(found)
        level = following
