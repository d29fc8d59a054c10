"""Whole jobs: detection, stores, reports, the command line, registered queries."""
