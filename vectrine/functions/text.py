"""Text functions: templates, paths, markup, and fuzzy names."""

from __future__ import annotations

import difflib
import email
import email.policy
import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

BANNED = '\\/:*?"<>|\r\n\t\0'


def safe_name(name: Column) -> Column:
    """Without the characters that paths can't hold."""
    return F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\r\n\t\x00]', ""))


def fields(*pairs: tuple[str, Column]) -> Column:
    """A document of ``[Label]: value`` lines."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"[{label}]: "), F.coalesce(value.cast("string"), F.lit(""))) for label, value in pairs))


def history_document(title: Column, url: Column, visited: Column, visits: Column, typed: Column) -> Column:
    return fields(
        ("Title", title), ("URL of the page", url), ("Last visited time", visited), ("Visit times", visits), ("Typed times", typed)
    )


def mail_document(file: Column, sender: Column, to: Column, subject: Column, date: Column, body: Column) -> Column:
    head = fields(("File", file), ("From", sender), ("To", to), ("Subject", subject), ("Date", date))
    return F.concat(head, F.lit("\n[EMAIL BODY Start]:\n"), F.coalesce(body, F.lit("")))


def mailbox_document(sender: Column, to: Column, subject: Column, date: Column, body: Column) -> Column:
    return F.concat(
        fields(("From", sender), ("To", to), ("Subject", subject), ("Date", date)),
        F.lit("\n[EMAIL BODY Start]:\n"),
        F.coalesce(body, F.lit(""))
    )


def chrome_time(micros: Column) -> Column:
    """A browser's microseconds since 1601 as a timestamp."""
    return F.timestamp_micros(micros - F.lit(11_644_473_600_000_000))


def stripped_markup(html: Column) -> Column:
    """Text of simple HTML: tags become spaces, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    """Visible text, with white space collapsed."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def mail_parts(raw: bytes, include_html: bool = False) -> dict[str, str]:
    """Headers and text of a MIME message; undecodable bytes are ignored."""
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    wanted = ("text/plain", "text/html") if include_html else ("text/plain",)
    parts = [p for p in message.walk() if p.get_content_type() in wanted and not p.is_multipart()]
    if not parts and not message.is_multipart():
        parts = [message]
    body = "\n".join(
        (p.get_payload(decode=True) or b"").decode(
            p.get_content_charset() or "utf-8", "ignore"
        ) if (
            p.get_content_charset() or "utf-8"
        ).lower() in _CODECS else (p.get_payload(decode=True) or b"").decode("utf-8", "ignore") for p in parts
    )
    return {
        "from": message.get("From", "Unknown"),
        "to": message.get("To", "Unknown"),
        "subject": message.get("Subject", "No Subject"),
        "date": message.get("Date", "Unknown"),
        "body": body
    }


_CODECS = {
    "utf-8",
    "us-ascii",
    "ascii",
    "iso-8859-1",
    "latin-1",
    "windows-1252",
    "cp1252",
    "iso-8859-15",
    "gbk",
    "gb2312",
    "big5",
    "shift_jis",
    "euc-jp",
    "euc-kr",
    "koi8-r",
    "utf-16"
}


def checked_model(name: str, known: list[str]) -> str:
    """``name`` if it is known, or the one known model that differs by case or by a missing tag; else an error that suggests others."""
    if name in known:
        return name
    same = [m for m in known if m.lower() == name.lower() or m.lower().split(":")[0] == name.lower()]
    if len(same) == 1:
        return same[0]
    likely = suggest(name, known)
    raise ValueError(f"unknown model {name!r}" + (f"; did you mean {', '.join(likely)}?" if likely else ""))


def suggest(name: str, known: list[str], limit: int = 8) -> list[str]:
    """Likely meanings of a misspelt name: the same but for case, then prefixes, parts, the same family, and close spellings."""
    low, found = name.lower(), []
    base = re.split(r"[:\-/]", low)[0]
    stages = (
        lambda m: m.lower() == low,
        lambda m: m.lower().startswith(low),
        lambda m: low in m.lower(),
        lambda m: re.split(r"[:\-/]", m.lower())[0] == base
    )
    for stage in stages:
        found += [m for m in known if stage(m) and m not in found]
    for cutoff in (0.4, 0.3):
        if len(found) < limit:
            found += [m for m in difflib.get_close_matches(name, known, n=3, cutoff=cutoff) if m not in found]
    return found[:limit]
