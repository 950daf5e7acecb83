"""Where the tests find the repository and its data."""

from __future__ import annotations

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SF_DIR = "/root/testdata/sf0.001"
