"""Readers of video metadata, captions, images and the frame store; adapters to outside tools."""
