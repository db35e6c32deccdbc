"""Raw archived mails to the texts a reader sees. Pure functions for Arrow workers."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator

_BREAKS = re.compile(r"\r\n?")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
_HEADER = re.compile(r"(?:From .*\n)?(?:[!-9;-~]+[ \t]*:.*(?:\n|\Z)(?:[ \t].*(?:\n|\Z))*)+")
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([^\s;\"]+)", re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
_HIDDEN = re.compile(r"<!--.*?-->|<(style|script|head|title)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_QUOTE_IN = re.compile(r"<blockquote\b[^>]*>", re.I)
_QUOTE_OUT = re.compile(r"</blockquote\s*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|tr|table|ul|ol|li|h[1-6]|hr|section|article|pre)\b[^>]*>", re.I)
_LINE = re.compile(r"[ \t]*\n?<br\b[^>]*>\n?", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_NAME = re.compile(r"name\*?[ \t]*=[ \t]*\"?[^\";\n]*\.(\w+)", re.I)
# Fields of which one at least stands in the head of a mail or of a part, and endings of text files.
_KNOWN = re.compile(
    r"^(?:from|to|cc|bcc|subject|date|message-id|in-reply-to|references|received|return-path|reply-to|sender|delivered-to|mime-version|content-[a-z-]+|x-[a-z-]+|list-[a-z-]+)[ \t]*:",
    re.I | re.M,
)
TEXT_FILES = "txt text log md csv tsv rst tex htm html".split()


def _fields(head: str) -> dict[str, str]:
    return {name.lower(): value for name, value in _FIELD.findall(head)}


def split_head(text: str) -> tuple[str, str]:
    """Header block and body; a text that does not start with header lines, a mail's or a part's field among them, is all body."""
    text = text.lstrip("\n")
    m = _HEADER.match(text)
    if not m or not _KNOWN.search(m.group()):
        return "", text
    head = m.group()
    body = text[m.end() :]
    return head, body[1:] if body.startswith("\n") else body


def _bytes_to_text(raw: bytes, charset: str) -> str:
    for name in ("utf-8", charset, "cp1252"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return raw.decode("latin-1")


def _repair(text: str) -> str:
    """UTF-8 that was read as a one-byte charset, put right if all of it decodes."""
    if "Ã" in text or "Â" in text or "â€" in text:
        for name in ("cp1252", "latin-1"):
            try:
                return text.encode(name).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


def decode(body: str, encoding: str, charset: str) -> str:
    """Undo a transfer encoding; a broken one yields what can be read."""
    encoding = encoding.strip().lower()
    if encoding.startswith("base64"):
        clean = _NOT_BASE64.sub("", body)
        clean = clean[: len(clean) - (len(clean) % 4 == 1)]
        try:
            raw = binascii.a2b_base64(clean + "=" * (-len(clean) % 4))
        except binascii.Error:
            return body
        return _bytes_to_text(raw, charset)
    if encoding.startswith("quoted-printable"):
        try:
            raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
        except (binascii.Error, UnicodeEncodeError):
            return body
        return _bytes_to_text(raw, charset)
    return body


def from_html(text: str) -> str:
    text = _HIDDEN.sub(" ", text)
    text = _LINE.sub("\n", text)
    text = _QUOTE_OUT.sub("\n\n", _QUOTE_IN.sub("\n\n", text))
    text = _BLOCK.sub("\n\n", text)
    return html.unescape(_TAG.sub("", text))


def parts(text: str | None) -> Iterator[tuple[str, bool, str]]:
    """(kind, attached, text) of every text part, decoded and without markup, however deeply it is nested.

    kind is `plain` or `html`; the parts of one multipart/alternative are all given. Null and empty texts have none.
    Parts of other types are left out, unless their file name has a text file's ending. A multipart without its boundary
    is read as text.
    """
    waiting = [_BREAKS.sub("\n", text)] if text else []
    while waiting:
        head, body = split_head(waiting.pop())
        f = _fields(head)
        kind = f.get("content-type", "text/plain").strip().lower()
        if kind.startswith("multipart/"):
            m = _BOUNDARY.search(f["content-type"])
            mark = "--" + (m.group(1) or m.group(2)) if m else None
            if mark and (body.startswith(mark) or "\n" + mark in body):
                waiting += reversed(list(_pieces(body, mark)))
                continue
            kind = "text/plain"
        encoding = f.get("content-transfer-encoding", "")
        if kind.startswith("message/"):
            waiting.append(decode(body, encoding, "utf-8"))
            continue
        if not kind.startswith("text/") and "/" in kind:
            m = _NAME.search(f.get("content-type", "")) or _NAME.search(f.get("content-disposition", ""))
            ending = m.group(1).lower() if m else ""
            if ending not in TEXT_FILES:
                continue
            kind = "text/html" if ending.startswith("htm") else "text/plain"
        m = _CHARSET.search(f.get("content-type", ""))
        out = _repair(decode(body, encoding, m.group(1) if m else "utf-8"))
        out = _BREAKS.sub("\n", out)
        attached = f.get("content-disposition", "").strip().lower().startswith("attachment")
        yield ("html", attached, from_html(out)) if kind.startswith("text/html") else ("plain", attached, out)


def _pieces(body: str, mark: str) -> Iterator[str]:
    for piece in ("\n" + body).split("\n" + mark)[1:]:
        if piece.startswith("--"):
            return
        piece = piece.partition("\n")[2]
        yield "Content-Type: text/plain\n" + piece if piece.startswith("\n") else piece
