"""Milestones of long requests."""

from __future__ import annotations

#: Of each kind of request the milestones (milliseconds, step, progress).
MILESTONES = {
    "cv_upload": ((0, 0, 8), (3500, 0, 26), (8000, 1, 52), (16000, 2, 78), (30000, 2, 88)),
    "manual_profile": ((0, 0, 8), (2500, 0, 28), (6000, 1, 56), (12000, 2, 82), (20000, 2, 88)),
    "matching": ((0, 0, 8), (3000, 0, 28), (7000, 1, 56), (14000, 2, 80), (24000, 2, 89)),
    "path_prep": ((0, 0, 8), (2500, 0, 30), (6500, 1, 58), (12000, 2, 82), (22000, 2, 89)),
}
#: Fixed value: progress never reads as done.
MOST = 95
