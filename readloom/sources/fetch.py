"""Source files from elsewhere: copied to where the workflows read them."""

from __future__ import annotations

import os
import shutil
import urllib.request
import uuid

from readloom.sources.files import system_of

MODES = ("yes", "no", "only")


def fetch(url: str, path: str) -> None:
    """Copies what ``url`` (http, https, ftp or file) names to ``path`` on any store; an existing file is replaced at the end."""
    system, at = system_of(path)
    if os.path.dirname(at):
        system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with urllib.request.urlopen(url) as source, system.open_output_stream(part, compression=None) as sink:
        shutil.copyfileobj(source, sink, 1 << 20)
    system.move(part, at)


def fetched(url: str | None, path: str, download: str = "no") -> bool:
    """Whether to go on with ``path``: ``yes`` copies first, ``no`` takes what is there, ``only`` copies and stops."""
    if download not in MODES:
        raise ValueError(f"download is one of {', '.join(MODES)}")
    if download != "no":
        if not url:
            raise ValueError("nothing to download: no address was given")
        fetch(url, path)
    return download != "only"
