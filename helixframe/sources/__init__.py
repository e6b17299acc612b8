"""Readers and writers of sequence and annotation formats."""
