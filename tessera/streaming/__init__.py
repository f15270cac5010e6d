"""The state machines of the batch operators over streams."""
