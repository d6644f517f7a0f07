"""Reusable DataFrame operators: upserts, lifecycles, identity resolution, permissions."""
