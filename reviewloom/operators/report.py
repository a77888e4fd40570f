"""The weekly report: small collected tables rendered on the driver as Markdown and HTML. All text is escaped."""

from __future__ import annotations

import hashlib
import html
import re

from reviewloom.operators.validate import REQUIRED_SECTIONS

NO_FEES = "No specific fee or charge confusion was found this week."


def truncate(text: str, limit: int) -> str:
    """As many whole words as fit into the limit, joined by single blanks, and dots if any are left out; a first word that is too long is cut."""
    kept, used = [], 0
    words = text.split()
    for word in words:
        used += len(word) + bool(kept)
        if used > limit:
            return (" ".join(kept) or word[:limit]) + "..."
        kept.append(word)
    return " ".join(kept)


def severity(avg: float) -> str:
    return "high" if avg <= 2.0 else "medium" if avg <= 3.4 else "low"


def markdown(product: str, themes: list[dict], quotes: list[dict], fees: dict, words: int = 250) -> str:
    """An extractive report with the required sections; quotes are verbatim.

    themes: rows with label, n, share_pct, avg_rating, rank; quotes: rows with text.
    """
    summary, supporting, observation, ideas = REQUIRED_SECTIONS
    top = sorted(themes, key=lambda t: t["rank"])[:3]
    lines = [f"# {product}: weekly reviews", "", f"## {summary}", ""]
    lines += [f"{i}. **{t['label']}**: {t['n']} reviews ({t['share_pct']} %), {t['avg_rating']} stars on average" for i, t in enumerate(top, 1)] or ["No themes this week."]
    lines += ["", f"## {supporting}", ""] + [f"> {' '.join(q['text'].split())}" for q in quotes[:3]]
    worst = min(themes, key=lambda t: (t["avg_rating"], t["rank"]), default=None)
    lines += ["", f"## {observation}", "", f"Lowest rated: {worst['label']} ({worst['avg_rating']} stars)." if worst else "Too few reviews."]
    lines += ["", f"## {ideas}", ""] + [f"- Look into {t['label']} ({severity(t['avg_rating'])} severity)" for t in top]
    if fees.get("n"):
        lines += ["", f"Fees and charges are mentioned in {fees['n']} reviews ({fees['pct_of_corpus']} %)."]
    return "\n".join(lines) + "\n"


def inline(body: str) -> str:
    """Bold, italics and links of an escaped line, read from left to right; marks without their counterpart stay as they are."""
    out, open_marks = [], []
    at = 0
    while at < len(body):
        mark = "**" if body.startswith("**", at) else body[at] if body[at] in "*[" else ""
        if mark == "[":
            middle = body.find("](", at)
            end = body.find(")", middle)
            target = body[middle + 2 : end] if 0 < middle < end else ""
            if target.startswith(("http://", "https://")) and not any(c.isspace() for c in target):
                out.append(f'<a href="{target}">{body[at + 1 : middle]}</a>')
                at = end + 1
                continue
        elif mark and mark in [m for m, _ in open_marks]:
            while True:
                m, place = open_marks.pop()
                if m == mark:
                    break
            tag = "strong" if mark == "**" else "em"
            out[place] = f"<{tag}>"
            out.append(f"</{tag}>")
            at += len(mark)
            continue
        elif mark and body.find(mark, at + len(mark)) > at + len(mark):
            open_marks.append((mark, len(out)))
        out.append(mark or body[at])
        at += len(mark) or 1
    return "".join(out)


def to_html(text: str) -> str:
    """Headings, quotes, list items, bold and links of a Markdown text as HTML."""
    out = []
    for line in text.splitlines():
        m = re.match(r"(#{1,6})\s+(.*)", line)
        body = html.escape(m.group(2) if m else re.sub(r"^(?:>+|[-*])\s*", "", line))
        body = inline(body)
        if m:
            out.append(f"<h{len(m.group(1))}>{body}</h{len(m.group(1))}>")
        elif line.startswith(">"):
            out.append(f"<blockquote>{body}</blockquote>")
        elif re.match(r"[-*]\s", line):
            out.append(f"<li>{body}</li>")
        elif body.strip():
            out.append(f"<p>{body}</p>")
    return "\n".join(out)


def report_key(product: str, week_start: str, week_end: str) -> str:
    return hashlib.sha256(f"{product}_{week_start}_{week_end}".encode()).hexdigest()[:12]
