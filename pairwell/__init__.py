"""Label denoising over (entity, category) observations, as DataFrame transformations."""
