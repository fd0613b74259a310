"""Command line of near-duplicate removal."""

from siltstone.plans.engine import fuzzy_job

if __name__ == "__main__":
    fuzzy_job()
