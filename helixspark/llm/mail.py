"""Messages as their readers see them: headers, parts, transfer encodings and markup undone."""

from __future__ import annotations

import binascii
import html
import re
from dataclasses import dataclass, field

_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_BOUNDARY = re.compile(r"""boundary=(?:"([^"\n]+)"|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset=["']?([\w.:-]+)""", re.I)
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"<(?:/?(?:p|br|div|tr|td|th|li|ul|ol|table|h[1-6]|blockquote|body|html|head|pre|hr)\b[^<>]*/?)>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Characters that no reader sees.
_UNSEEN = re.compile("[­​‌‍⁠﻿]")


@dataclass
class Part:
    """A leaf of a message: its type, its transfer encoding, its body as sent, and whether the next boundary was reached."""

    kind: str
    encoding: str
    charset: str
    body: str
    closed: bool = True


@dataclass
class Message:
    headers: dict[str, str] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)
    #: The headers ended with a blank line; every opened boundary was closed.
    headers_end: bool = True
    closed: bool = True


def _split(text: str) -> tuple[dict[str, str], str, bool]:
    """Headers (names in lower case, folded lines joined), body, and whether a blank line ended the headers."""
    if not _HEADER.match(text):
        return {}, text, True
    end = text.find("\n\n")
    head, body = (text, "") if end < 0 else (text[:end], text[end + 2 :])
    out: dict[str, str] = {}
    name = ""
    for line in head.split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        if not _HEADER.match(line):
            if name:
                return out, text[text.find(line) :], True  # no blank line, but this is no header any more
            return {}, text, True
        name, _, value = line.partition(":")
        name = name.lower()
        out[name] = value.strip()
    return out, body, end >= 0


def parse(text: str) -> Message:
    """Parts of a message in order; text without headers is one plain part.

    Parts within parts are opened however deep they lie, forwarded messages
    (``message/rfc822``) too, whose transfer encoding is undone first.  The
    stack is explicit.
    """
    headers, body, ended = _split(text.replace("\r\n", "\n"))
    message = Message(headers, headers_end=ended)
    stack = [(headers, body, True)]
    while stack:
        inner, content, closed = stack.pop()
        kind = inner.get("content-type", "text/plain")
        mark = _BOUNDARY.search(kind) if kind.lower().startswith("multipart") else None
        if mark:
            # the last part comes first on the stack, so parts come out in order
            stack += reversed(_parts(content, mark[1] or mark[2], message))
            continue
        charset = _CHARSET.search(kind)
        part = Part(
            kind.partition(";")[0].strip().lower(), inner.get("content-transfer-encoding", "7bit").strip().lower(), charset[1] if charset else "utf-8", content, closed)
        held = _split(decode(part).lstrip("\n")) if part.kind == "message/rfc822" else ({}, "", True)
        if held[0]:
            stack.append((held[0], held[1], closed))
        else:
            message.parts.append(part)
    return message


def _parts(body: str, boundary: str, message: Message) -> list[tuple[dict[str, str], str, bool]]:
    """``(headers, body, closed)`` of each piece between boundaries; marks the message where one stays open."""
    out = []
    pieces = re.split(rf"(?m)^--{re.escape(boundary)}(--)?[ \t]*(?:\n|\Z)", body)
    # pieces: preamble, end mark, part, end mark, part, ...
    finished = False
    for i in range(1, len(pieces) - 1, 2):
        if pieces[i]:
            finished = True
            break
        inner, content, ended = _split(pieces[i + 1])
        if not inner and pieces[i + 1].startswith("\n"):
            content = pieces[i + 1][1:]
        last = i + 3 > len(pieces)
        if not ended and last:
            message.headers_end = False
        out.append((inner, content.removesuffix("\n") if not last else content, not last))
    if not finished:
        message.closed = False
    return out


def decode(part: Part) -> str:
    """The part's text with its transfer encoding undone; an incomplete end is left out."""
    if part.encoding == "base64":
        letters = re.sub(r"[^A-Za-z0-9+/]", "", part.body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        raw = binascii.a2b_base64(letters + "=" * (-len(letters) % 4))
    elif part.encoding == "quoted-printable":
        raw = binascii.a2b_qp(part.body.encode("utf-8", "replace"))
    else:
        return part.body
    try:
        return raw.decode(part.charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def unmarked(text: str) -> str:
    """Text of an HTML page: blocks on lines of their own, other tags gone, entities resolved."""
    text = _DROPPED.sub(" ", text)
    return html.unescape(_TAG.sub("", _BLOCK.sub("\n", text)))


def seen(text: str) -> list[str]:
    """What a reader sees of a message, one text for each text part; attachments are not read."""
    out = []
    for part in parse(text).parts:
        if part.kind.startswith("text/") or part.kind in ("", "message/rfc822"):
            body = decode(part)
            out.append(unmarked(body) if part.kind == "text/html" else body)
    return out


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(_UNSEEN.sub("", text).lower())
