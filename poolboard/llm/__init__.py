"""Operators for preparing training text at scale: quality, secrets, copies, mixing, scoring, packing and token files."""
