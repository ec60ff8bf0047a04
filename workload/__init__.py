"""Registered queries over the given tables; ``workload.all`` loads every one of them."""
