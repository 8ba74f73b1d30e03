"""A search page over a persisted index: / and /search?q=...&page=..., fifty hits a page."""

from __future__ import annotations

import html
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from tessel.operators import boolean as B
from tessel.operators import ranked as R
from tessel.sources.tables import Index

FORM = '<form action="/search"><input name="q" value="{q}" size="60"> <button>Search</button></form>'


def page_number(text: str) -> int:
    """The page asked for; anything that isn't a number from 0 is the first."""
    return int(text) if text.isdigit() else 0


def results(index: Index, query: str, page: int) -> tuple[int, list]:
    """Hits in all, and the rows of one page in ranked order."""
    found = R.ranked_search(index.postings, index.forward, query, index.n_docs, index.options)
    cut = found.orderBy(found["score"].desc(), "doc_id").offset(page * B.PAGE).limit(B.PAGE)
    rows = B.with_metadata(cut, index.forward)
    return found.count(), rows.orderBy(rows["score"].desc(), "doc_id").collect()


def render(query: str, page: int, hits: int, rows: list) -> str:
    items = "".join(f'<li value="{page * B.PAGE + i + 1}"><a href="{html.escape(r["url"], quote=True)}">{html.escape(r["title"])}</a> {r["score"]:.4g}</li>' for i, r in enumerate(rows))
    link = lambda p, label: f'<a href="/search?q={quote(query)}&amp;page={p}">{label}</a> '
    turn = (link(page - 1, "back") if page else "") + (link(page + 1, "next") if (page + 1) * B.PAGE < hits else "")
    return f"{FORM.format(q=html.escape(query, quote=True))}<p>{hits} hits</p><ol>{items}</ol><p>{turn}</p>"


def respond(index: Index, target: str) -> tuple[int, str]:
    """Status and body for a request target."""
    asked = urlsplit(target)
    values = parse_qs(asked.query)
    query, page = values.get("q", [""])[0].strip(), page_number(values.get("page", [""])[0])
    if asked.path == "/" or (asked.path == "/search" and not query):
        return 200, FORM.format(q="")
    if asked.path != "/search":
        return 404, "not found"
    try:
        return 200, render(query, page, *results(index, query, page))
    except B.QueryError as e:
        return 500, f"{FORM.format(q=html.escape(query, quote=True))}<p>{html.escape(str(e))}</p>"


def serve(index: Index, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            start = time.perf_counter()
            status, body = respond(index, self.path)
            data = f'<!doctype html><meta charset="utf-8"><title>Search</title>{body}<p>{(time.perf_counter() - start) * 1000:.0f} ms</p>'.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
