"""Streaming forms of the operators; replaying a finite input gives what the batch form gives."""
