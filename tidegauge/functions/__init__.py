"""Scalar and validation expressions over columns."""

from tidegauge.functions.scalars import *  # noqa: F403
