"""The canonical form, once more and plainly, for brute-force checks."""

import json

import regex

STRIP = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")


def flat(o):
    if isinstance(o, dict):
        return " ".join(f"{k} {flat(o[k])}" for k in sorted(o))
    return " ".join(map(flat, o)) if isinstance(o, list) else json.dumps(o, ensure_ascii=False)


def canon(text):
    m = regex.search(r"\{.*\}", text, regex.S)
    if m and regex.match(r"\W*tool_use", text, regex.I):
        try:
            text = text[: m.start()] + flat(json.loads(m[0].casefold())) + text[m.end() :]
        except ValueError:
            pass
    return STRIP.sub("", text.casefold())
