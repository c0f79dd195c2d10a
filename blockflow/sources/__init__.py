"""Inputs: tables mapped to blocks, frames, planes and feedback streams."""
