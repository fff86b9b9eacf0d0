"""Answers in place of a network, for the paged source."""

import json
from urllib.parse import parse_qs, urlparse

PAGES = {1: [{"new_path": "a"}, {"new_path": "b"}], 2: [{"new_path": "c"}], 3: []}


def answer(url, headers, timeout, data=None):
    page = int(parse_qs(urlparse(url).query).get("page", ["1"])[0])
    if "denied" in url:
        return 403, {}, "no"
    if "down" in url:
        return None, {}, "refused"
    return 200, {"x-next-page": str(page + 1)}, json.dumps(PAGES[page])
