"""DataFrame operators over intervals, tags, sequences, frames, edits and vectors."""
