"""Registered queries and their SQL counterparts, by area."""

from entries import activity, corpus_health, retrieval

AREAS = [retrieval, corpus_health, activity]
