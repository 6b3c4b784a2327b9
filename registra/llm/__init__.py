"""Training-data operators; nothing else in registra imports this subpackage."""
