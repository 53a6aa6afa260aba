"""Main text of pages by brute force: every window of tokens of a host with the set of streams that hold it."""

from collections import defaultdict
from urllib.parse import urlsplit

from siltstone.llm.extraction import DROP, KEEP, blocks


def extracted(pages: list[tuple], least: int = 10, least_pages: int = 3, cover: float = 0.5) -> list[tuple]:
    """page_id, url and text of pages given as page_id, url and html."""
    parsed = [(i, url, [(kind, text.split()) for kind, text in blocks(html or "")]) for i, url, html in pages]
    holders: dict = defaultdict(lambda: defaultdict(set))
    streams: dict = defaultdict(set)
    for _, url, found in parsed:
        stream = tuple(t for _, tokens in found for t in tokens)
        streams[host(url)].add(stream)
        for k in range(len(stream) - least + 1):
            holders[host(url)][stream[k : k + least]].add(stream)
    out = []
    for i, url, found in parsed:
        stream = tuple(t for _, tokens in found for t in tokens)
        enough = max(2, min(least_pages, len(streams[host(url)])))
        gone = set()
        for k in range(len(stream) - least + 1):
            if len(holders[host(url)][stream[k : k + least]]) >= enough:
                gone.update(range(k, k + least))
        main = [k for k, kind in enumerate(kind for kind, tokens in found for _ in tokens) if kind == KEEP]
        copy = main and len(gone.intersection(main)) > cover * len(main)
        lines, at = [], 0
        for kind, tokens in found:
            left = [t for k, t in enumerate(tokens, at) if k not in gone or (kind == KEEP and copy)]
            at += len(tokens)
            if kind != DROP and left:
                lines.append(" ".join(left))
        out.append((i, url, "\n".join(lines)))
    return out


def host(url: str | None) -> str:
    return (urlsplit(url).hostname or "") if url and "://" in url else ""
