"""State that Arrow workers keep from one task to the next."""

from __future__ import annotations

import sys
import types


def kept(name: str, make):
    """The worker process's object of that name, made at first use. Functions shipped by value have no globals of their own to keep it in."""
    home = sys.modules.setdefault("_kinweave_kept", types.ModuleType("_kinweave_kept"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
