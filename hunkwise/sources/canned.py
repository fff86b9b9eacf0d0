"""Answers in place of outer services, made from the address alone; for the registered queries, which may not reach a network."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qs, unquote, urlsplit

ITEMS = 250


def answer(url: str, headers: dict[str, str], timeout: float, data: bytes | None = None) -> tuple[int | None, dict[str, str], str]:
    """A number n at the end of a path's item decides: 7 divides n, not found; 11, forbidden; 13, a server's error; 17, no connection."""
    parts = urlsplit(url)
    asked, path = parse_qs(parts.query), parts.path
    if path.endswith("/diffs"):
        page, size = int(asked["page"][0]), int(asked["per_page"][0])
        items = [{"new_path": f"src/{i}"} for i in range(ITEMS)][(page - 1) * size : page * size]
        return 200, {"x-next-page": str(page + 1) if page * size < ITEMS else ""}, json.dumps(items)
    n = int(re.findall(r"[0-9]+", path)[-1])
    for divisor, status in ((7, 404), (11, 403), (13, 500)):
        if n % divisor == 0:
            return status, {}, f"no {n}"
    if n % 17 == 0:
        return None, {}, "refused"
    if data is not None:
        text = parse_qs(data.decode())["body"][0]
        notes = [] if n % 5 == 0 else [{"id": n, "body": text.upper(), "web_url": f"http://h/note/{n}", "noteable_iid": n % 3}]
        return 201, {}, json.dumps({"id": f"d{n}", "individual_note": n % 2 == 0, "notes": notes})
    if path.endswith("/raw"):
        return 200, {}, f"{unquote(path).split('/repository/files/')[1]}@{asked['ref'][0]}"
    if path.endswith("/versions"):
        return 200, {}, json.dumps([{"head_commit_sha": f"h{n}-{i}"} for i in range(n % 3)])
    if "/issue/" in path:
        return 200, {}, json.dumps({"key": f"K-{n}", "fields": {"summary": f"s{n}", "n_fields": len(asked["fields"][0].split(","))}})
    return 200, {}, json.dumps({"id": n, "iid": n, "title": f"t{n}"})


def provider(system: str, text: str, options: dict) -> str:
    """A model that fails on texts of odd length beyond 700 code points, and has nothing to say of those that 5 divides."""
    if len(text) > 700 and len(text) % 2:
        raise ValueError("too long")
    return "" if len(text) % 5 == 0 else json.dumps({"issues": [], "limit": options["max_tokens"], "strict": options["response_format"]["json_schema"]["strict"]})
