"""Readers. Paths are given by the caller; nothing is downloaded."""
