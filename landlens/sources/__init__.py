"""Readers, decoders and writers of the engine's table formats."""
