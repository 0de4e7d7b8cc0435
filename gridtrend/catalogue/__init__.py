"""Every registered query and its SQL oracle."""

from gridtrend.catalogue import field, modelling, posterior, weather

_MODULES = (field, weather, modelling, posterior)
QUERIES = {name: build for m in _MODULES for name, build in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
