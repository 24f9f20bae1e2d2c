"""Intermediate tables of the operators, in the folder that the whole cluster shares."""

from ..shared import delete, discard, fresh_path, give_back, save, shared_dir, spread, sweep

__all__ = ["delete", "discard", "fresh_path", "give_back", "save", "shared_dir", "spread", "sweep"]
