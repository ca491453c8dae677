"""Readers and the projections that turn raw documents into the fact tables."""
