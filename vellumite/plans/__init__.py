"""Registered queries: each a plan over the driver's tables or over a literal relation, with its SQL."""
