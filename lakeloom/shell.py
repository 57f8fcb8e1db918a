"""Statements of the dialect from a terminal or a pipe: python -m lakeloom.shell STORE_PATH [< script.sql]"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from lakeloom.plans.engine import Session


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Texts up to a semicolon outside quotes; the last may lack it."""
    text, quoted = "", False
    for ch in "".join(line if line.endswith("\n") else line + "\n" for line in lines):
        text += ch
        quoted ^= ch == "'"
        if ch == ";" and not quoted:
            yield text.strip()
            text = ""
    if text.strip():
        yield text.strip()


def run(session: Session, lines: Iterable[str]) -> Iterator[str]:
    """The reply to each statement, until one says exit; the session is closed at the end."""
    for text in statements(lines):
        reply = session.execute(text)
        yield reply
        if reply == "Bye.":
            return
    session.close()


def main() -> None:
    from lakeloom.plans.engine import Engine
    from lakeloom.session import session

    for reply in run(Engine(session("shell"), sys.argv[1]).session(), sys.stdin):
        print(reply, flush=True)


if __name__ == "__main__":
    main()
