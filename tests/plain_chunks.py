"""The chunker as a sequential program over one note: the yardstick for the plan over lines."""

from __future__ import annotations

import re

from noteloom.schema import LEAST_PARAGRAPH, MAX_CHUNK, MERGE_BELOW


def pack(parts: list[str], joint: str, size: int = MAX_CHUNK) -> list[str]:
    """Parts joined in order while they fit; one that is too long stands alone."""
    out: list[str] = []
    held = ""
    for p in parts:
        if held and len(held) + len(p) + len(joint) > size:
            out.append(held.strip())
            held = p
        else:
            held = held + joint + p if held else p
    if held.strip():
        out.append(held.strip())
    return out


def split_large(text: str, size: int = MAX_CHUNK) -> list[str]:
    """Natural boundaries in order of preference: rules, blank lines, line ends."""
    if len(text) <= size:
        return [text]
    rules = re.split(r"\n(?:---|___|\*\*\*)\n", text)
    if len(rules) > 1:
        return [x for r in rules if r.strip() for x in split_large(r.strip(), size)]
    paragraphs = text.split("\n\n")
    return pack(paragraphs, "\n\n", size) if len(paragraphs) > 1 else pack(text.split("\n"), "\n", size)


_KINDS = (("list", re.compile(r"^\s*(?:[-*+]|\d+\.)\s+")), ("quote", re.compile(r"^\s*>")), ("table", re.compile(r"^\s*\|.*\|\s*$")))
_HEADER = re.compile(r"^(#{1,6})\s+(.+)$")
_TAG, _LINK = re.compile(r"#(\w[\w/-]+)"), re.compile(r"\[\[([^\]]+)\]\]")


def _blocks(lines: list[str], start: int, end: int) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of fenced code, lists, quotes and tables in a range."""
    out, i = [], start
    while i < end:
        if lines[i].startswith("```"):
            close = next((j for j in range(i + 1, end) if lines[j].startswith("```")), None)
            if close is not None:
                out.append(("code_block", i, close))
                i = close + 1
                continue
        kind = next((k for k, p in _KINDS if p.match(lines[i])), None)
        if kind is None:
            i += 1
            continue
        j = i
        while j + 1 < end and dict(_KINDS)[kind].match(lines[j + 1]):
            j += 1
        out.append((kind, i, j))
        i = j + 1
    return out


def _content(lines: list[str], start: int, end: int) -> list[tuple[str, str, int, int]]:
    """(kind, text, first line, last line): blocks, and the paragraphs between them."""
    out, at = [], start

    def gap(a: int, b: int) -> None:
        text = "\n".join(lines[a:b]).strip()
        if len(text) > LEAST_PARAGRAPH:
            out.extend(("paragraph", t, a, b - 1) for t in split_large(text))

    for kind, a, b in _blocks(lines, start, end):
        gap(at, a)
        out.append((kind, "\n".join(lines[a + 1 : b] if kind == "code_block" else lines[a : b + 1]), a, b))
        at = b + 1
    gap(at, end)
    return out


def semantic_chunks(note_id: str, text: str, front: str = "") -> list[dict]:
    """Chunks of one note before scores: front matter, preamble, sections; small neighbours merged."""
    lines = text.split("\n")
    heads, fenced = [], False
    for i, line in enumerate(lines):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else _HEADER.match(line)
        if m:
            heads.append((i, len(m[1]), m[2].strip()))
    found: list[dict] = []

    def add(kind, content, a, b, level=None, title=None, above=()):
        found.append({"chunk_type": kind, "content": content, "start_line": a, "end_line": b, "header_level": level, "header_text": title, "parent_headers": list(above), "contains_tags": _TAG.findall(content), "contains_links": _LINK.findall(content)})

    if front:
        add("frontmatter", front, 0, 0)
    for kind, content, a, b in _content(lines, 0, heads[0][0] if heads else len(lines)):
        add(kind, content, a, b)
    stack: list[tuple[int, str]] = []
    for k, (i, level, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        while stack and stack[-1][0] >= level:
            stack.pop()
        above = [t for _, t in stack]
        stack.append((level, title))
        section = "\n".join(lines[i:end])
        if len(section) <= MAX_CHUNK:
            add("section", section, i, end - 1, level, title, above)
        else:
            for kind, content, a, b in _content(lines, i + 1, end):
                add(kind, content, a, b, level, title, above)
    return [c | {"note_id": note_id, "chunk_id": f"{note_id}/chunk_{c['position']}", "seq": n} for n, c in enumerate(merge_small([c | {"position": p} for p, c in enumerate(found)]))]


def merge_small(chunks: list[dict], below: int = MERGE_BELOW) -> list[dict]:
    """Fold neighbours of one type and header while both are short."""
    out: list[dict] = []
    for c in chunks:
        p = out[-1] if out else None
        alike = p and all(p[f] == c[f] for f in ("chunk_type", "header_level", "header_text"))
        if alike and len(p["content"]) < below and len(c["content"]) < below:
            both = lambda f: sorted({*p[f], *c[f]})  # noqa: B023, E731
            out[-1] = p | {"content": p["content"] + "\n\n" + c["content"], "end_line": c["end_line"], "contains_tags": both("contains_tags"), "contains_links": both("contains_links")}
        else:
            out.append(c)
    return out
