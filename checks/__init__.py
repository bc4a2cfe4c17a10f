"""Registered queries with the SQL they must agree with."""

from checks import clinical, jobs, lake, stats, texts

ALL = [lake.reg, stats.reg, clinical.reg, texts.reg, jobs.reg]
