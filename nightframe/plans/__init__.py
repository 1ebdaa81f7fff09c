"""Registered queries; importing the package fills the registry."""

from . import appends, backtests, beds, calendar, core, engine, frames, guards, lists, recordings, registry, rules, sequences, sessions, shapes, signals, store, stored, streams, trackers  # noqa: F401
