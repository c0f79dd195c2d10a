"""Operators over frames, blocks, bitstreams and control signals. Each module has CATALOG: name -> (query, oracle SQL or None)."""
