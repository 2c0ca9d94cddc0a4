"""Settings from a configuration file of ``keyword value`` lines."""

from __future__ import annotations


def entries(text: str) -> list[tuple[str, str]]:
    """Keyword and value of each line, in order; comments and blank lines are left out."""
    out = []
    for line in text.splitlines():
        words = line.split("#", 1)[0].split(None, 1)
        if words:
            out.append((words[0], words[1].strip() if len(words) > 1 else ""))
    return out


def index_root(text: str, keyword: str) -> str:
    """The last value of the keyword; a missing or empty one is an error, as there is then no index to open."""
    values = [v for k, v in entries(text) if k == keyword]
    if not values or not values[-1]:
        raise ValueError(f"the configuration names no index: {keyword} is missing or empty")
    return values[-1]


def page_directories(text: str, keyword: str) -> list[str]:
    """Every directory named by the keyword, each once, in order."""
    return list(dict.fromkeys(v.rstrip("/") or "/" for k, v in entries(text) if k == keyword and v))
